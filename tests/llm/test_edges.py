"""Every operator on null, empty, long, repeated and clashing input, against brute force; and on empty tables."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from segment_lab.llm import byte_repeats, language, licenses, mixing, packing, quality, simhash, substrings, warc, winnowing
from segment_lab.llm.queries import vocabulary

WORD = "[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def bag(items):
    return Counter(items)


# ---------------------------------------------------------------- 1 packing

def test_packing_is_exact_and_gapless(edge):
    from tokenizers import Tokenizer
    got = packing.pack_documents(edge, vocabulary(), size=512).collect()
    fixed = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t in rows_of(edge):
        ids = np.array(fixed.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p, s in enumerate(range(0, len(ids), 512)):
            part = ids[s:s + 512]
            want[(i, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512


def test_packing_plan_fills_gaps_exactly():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = Counter(rng.integers(1, 101, int(rng.integers(1, 400))).tolist())
        plan = packing.plan_patterns(lengths, 100)
        used = Counter()
        for pattern, times in plan:
            assert sum(k * v for k, v in pattern.items()) <= 100 and times > 0
            for k, v in pattern.items():
                used[k] += v * times
        assert used == lengths
        large = sum(v for k, v in lengths.items() if k > 50) + -(-lengths[50] // 2)  # no two of them fit together
        least = max(large, -(-sum(k * v for k, v in lengths.items()) // 100))
        assert sum(t for _, t in plan) <= least + max(2, least // 10)
    # one, two and three complements are found exactly
    assert sum(t for _, t in packing.plan_patterns({60: 1, 40: 1, 50: 1, 30: 1, 20: 1, 55: 1, 15: 2}, 100)) == 3


def test_packing_keeps_ids(edge):
    for r in packing.pack_documents(edge.where("doc_id in (1, 4, 8)"), vocabulary(), keep_ids=True).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


# ---------------------------------------------------------------- 2 substrings

def test_word_windows(edge):
    data = rows_of(edge)
    least = {}
    rank = lambda i: (i is None, i or 0)  # noqa: E731  a null id is larger than all
    for i, t in data:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            least[g] = min(least.get(g, rank(i)), rank(i))
    want = Counter()
    for i, t in data:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if least[tuple(w[k:k + 13])] < rank(i):
                gone |= set(range(k, k + 13))
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    got = substrings.remove_repeats(edge).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    for r in got:
        spans = [(s.first, s.last) for s in r.removed]
        assert sum(b - a for a, b in spans) == r.n_removed
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))  # maximal runs do not touch


def test_packed_hashes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        for top in (300, 1 << 40, 1 << 63):
            v = np.unique(rng.integers(0, top, n).astype(np.uint64) * np.uint64(2))
            assert (substrings.unpack(substrings.pack(v)) == v).all()


# ---------------------------------------------------------------- 3 quality

def base(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    twice = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(twice),
            len(w) < 10 or 100 * len(twice) > 20 * len(w))


def test_quality_base_counts(spark, edge):
    more = spark.createDataFrame([(100, "a b\na b\n\n c\nc \na b"), (101, "#| <x>\n#| <x>"), (102, "\n\n")], "doc_id long, text string")
    both = edge.select("doc_id", "text").union(more)
    got = quality.judge(both, None).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag((r.doc_id, *(r[c] for c in names)) for r in got) == bag((i, *base(t)) for i, t in rows_of(both))
    assert all(r.kept == (not r.base_failed) for r in got)  # without a field all lines are content


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(3)
    for _ in range(30):
        field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
        sizes = rng.integers(1, 7, 4)
        owner, x = np.repeat(np.arange(4), sizes), rng.normal(size=(sizes.sum(), 3))
        got = field.viterbi(x, owner)
        for d in range(4):
            e = x[owner == d] @ field.emit
            score = lambda y: sum(e[k] * y[k] for k in range(len(y))) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
            best = max((score(y), y) for y in np.ndindex(*[2] * len(e)))
            assert abs(score(got[owner == d].astype(int).tolist()) - best[0]) < 1e-9


def test_field_learns_separable_lines(spark):
    rng = np.random.default_rng(4)
    make = lambda bad: np.stack([np.ones(6), rng.random(6) < (0.9 if bad else 0.1)], axis=1).astype(float)
    labels = [int(k % 3 == 0) for k in range(90)]
    field = quality.fit_field([make(b) for b in labels], labels)
    right = sum((field.viterbi(make(b), np.zeros(6, int)).mean() > 0.5) == b for b in labels * 3)
    assert right >= 0.95 * 270


def test_training_without_both_labels(spark, edge):
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (7, None)], "doc_id long, quality int")
    assert quality.train(edge, labels) is None
    assert quality.train(edge, labels.limit(0)) is None


# ---------------------------------------------------------------- 4 language

def greedy(text, sample):
    x = language.normalise(text or "")
    return count(x + " " if x and not text[-1].isalpha() else x, sample)


def test_cross_parsing_counts_phrases():
    samples = {"a": language.normalise("the cat sat on the mat and the dog ran to the cat"),
               "b": language.normalise("le chat est sur la table et le chien court après le chat")}
    model = language.Model(samples)
    texts = ["the dog sat", "le chien, 12 chats!", "", "zzz the é", "The CAT  and", "the cat sat " * 50, None, "..", "日本 the"]
    flat, sizes, letters = model.symbols_of(texts)
    got = model.phrases(flat, sizes)
    for k, t in enumerate(texts):
        if letters[k] or not sizes[k]:
            assert got[:, k].tolist() == [greedy(t, s) for s in samples.values()], t


def test_long_texts_are_parsed_in_blocks(monkeypatch):
    sample = {"a": "the cat sat on the mat"}
    model = language.Model(sample)
    text = "the mat sat on cat " * 20
    monkeypatch.setattr(language, "BLOCK", 64)
    flat, sizes, _ = model.symbols_of([text, "the cat"])
    whole = language.normalise(text) + " "
    assert model.phrases(flat, sizes)[0].tolist() == [sum(count(whole[k:k + 64], sample["a"]) for k in range(0, len(whole), 64)), 1]


def count(x, sample):
    n = i = 0
    while i < len(x):
        j = i
        while j < len(x) and x[i:j + 1] in sample:
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


def test_language_edges(edge):
    got = language.identify(edge, samples={"en": "the quick brown fox", "de": "der schnelle braune fuchs"}).collect()
    text = defaultdict(list)
    for i, t in rows_of(edge):
        text[i].append(t)
    assert len(got) == edge.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if len(text[r.doc_id]) == 1:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id][0] or ""))
    kept = language.keep_identified(edge)
    assert kept.columns == edge.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in rows_of(edge))


def test_language_learns_only_from_other_rows(spark, edge):
    rows = spark.createDataFrame([(i, f"word{i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    seen = language.training_samples(rows, "doc_id", "text", "lang")["en"]
    want = {language.normalise(f"word{i}") for i in range(40)}
    assert set(seen.split()) <= want
    held = rows.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    assert language.training_samples(held, "doc_id", "text", "lang") == {}
    assert {r.lang_pred for r in language.identify(held).collect()} == {"und"}


# ---------------------------------------------------------------- 5 suffixes

def test_suffix_order_is_the_suffix_array():
    from segment_lab.llm.suffix_groups import suffix_order
    rng = np.random.default_rng(5)
    for _ in range(400):
        s = rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(0, 40)))
        x = s.tolist()
        assert suffix_order(s).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute_bytes(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return out


def test_repeated_bytes(edge):
    data = [(i, (t or "").encode()) for i, t in rows_of(edge)]
    want = Counter()
    for (i, t), gone in zip(data, brute_bytes([t for _, t in data], 200)):
        want[(i, len(t), int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone]))] += 1
    got = byte_repeats.remove_repeats(edge.select("doc_id", "text")).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == want
    for r in got:
        assert sum(s.last - s.first for s in r.removed) == r.n_removed
        assert all(x.last < y.first for x, y in zip(r.removed, r.removed[1:]))


def test_crowded_anchors_are_counted_by_window(edge, monkeypatch):
    want = bag((r.doc_id, r.n_removed, bytes(r.kept)) for r in byte_repeats.remove_repeats(edge.select("doc_id", "text")).collect())
    n, length, margin = 4, 200, 32
    import pyarrow as pa
    data = rows_of(edge)
    parts = [data[k::3] for k in range(3)]
    column = [pa.array([t for _, t in p], pa.string()) for p in parts]
    monkeypatch.setattr(byte_repeats, "CROWD", 0)
    first = [m for b, c in enumerate(column) for m in byte_repeats.send_anchors(c, b, n, length, margin)]
    told = [m for k in range(n) if any(x[0] == k for x in first) for m in byte_repeats.count_anchors(byte_repeats._table([x for x in first if x[0] == k]))]
    assert told and all(m[2] == byte_repeats.CROWDED for m in told)
    second = [m for b, c in enumerate(column) for m in byte_repeats.send_contexts(c, byte_repeats._table([x for x in told if x[1] == b]), b, n, length, margin)]
    answers = [m for k in range(n) for m in byte_repeats.resolve(byte_repeats._table([x for x in second if x[0] == k]), length)]
    got = Counter()
    for b, (c, p) in enumerate(zip(column, parts)):
        data_, off, gone = byte_repeats.covered(c, byte_repeats._table([x for x in answers if x[1] == b]), length, margin)
        for k, (i, _) in enumerate(p):
            s = slice(off[k], off[k + 1])
            got[(i, int(gone[s].sum()), bytes(data_[s][~gone[s]]))] += 1
    assert got == want


def test_unrepeated_texts_stay_valid(edge):
    kept = byte_repeats.keep_unrepeated(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    for r in kept.collect():
        assert r.text is None or (r.n_chars == len(r.text) and "�" not in r.text)
    assert kept.where("text is null").count() == edge.where("text is null").count()


# ---------------------------------------------------------------- 6 WARC

def test_warc_round_trip(spark, tmp_path):
    big, other = "x" * 1000, "é" * 500
    data = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, "http://b/3", big), (4, None, other), (5, "http://a/5", other),
            (6, "http://a/6", "x" * 999), (7, "http://a/7", "x" * 999), (8, "http://a/8", None), (9, "http://a/9", ""), (9, "http://a/9", ""),
            (None, "http://n", big), (10, "u", "WARC/1.1\r\n\r\n\r\n"), (11, "long", "é\r\n\r\n" * 300_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("payload", "first", "id")})
    got = warc.round_trip(pages).collect()
    largest = defaultdict(int)
    for i, _, h in data:
        largest[h or ""] = max(largest[h or ""], i or 0)
    want = Counter()
    for i, _, h in data:
        h = h or ""
        again = len(h.encode()) >= 1000 and i != largest[h]
        want[(i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", largest[h] if again else None)] += 1
    assert bag((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_warc_round_trip_reads_each_kind_by_itself(spark, monkeypatch):
    scans, read = [], warc.read_archive

    def watched(*args, **kw):
        scans.append(read(*args, **kw))
        return scans[-1]
    monkeypatch.setattr(warc, "read_archive", watched)
    pages = spark.createDataFrame([(1, "u", "x" * 1000), (2, "u", "x" * 1000), (3, "u", "y")], "page_id long, url string, html string")
    out = warc.round_trip(pages)
    assert sorted((r.page_id, r.record_type) for r in out.collect()) == [(1, "revisit"), (2, "response"), (3, "response")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(scans) == 2 and scans[1].where("payload is not null").count() == 0
    # a predicate that the reader takes leaves no filter on the record type above the scan
    assert not [x for x in plan.splitlines() if "Filter" in x and "record_type" in x and "= re" in x]



def test_warc_reader_skips_by_header(spark, tmp_path):
    import io
    rows = [{"record_id": f"<urn:x-record:{k}>", "record_type": "response" if k % 2 else "revisit", "target_uri": f"http://h/{k}", "date": warc.DATE,
             "refers_to": None, "payload_digest": "sha1:0", "payload_bytes": 9, "payload": b"p" * 3_000_000 if k % 2 else None} for k in range(8)]
    raw = b"".join(map(warc.record_bytes, rows))

    class Counting(io.BytesIO):
        def read(self, n=-1):
            self.got = getattr(self, "got", 0) + len(x := super().read(n))
            return x

    everything = list(warc.records(Counting(raw), lambda r: True, True))
    assert [len(r["payload"] or b"") for r in everything] == [3_000_000 if k % 2 else 0 for k in range(8)]
    heads = list(warc.records(Counting(raw), lambda r: r["record_type"] == "revisit", True))
    assert [r["record_id"] for r in heads] == [f"<urn:x-record:{k}>" for k in (0, 2, 4, 6)]
    # predicates reach the reader, and files are planned into several partitions
    path = str(tmp_path / "warc")
    df = spark.createDataFrame([(r["record_id"], r["record_type"], r["target_uri"], r["date"], r["refers_to"], r["payload_digest"], r["payload_bytes"],
                                 r["payload"]) for r in rows], warc.SCHEMA).repartition(4)
    warc.write_archive(df, path)
    reader = warc.WarcReader(path, True, 1)
    from pyspark.sql.datasource import EqualTo, StringStartsWith
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("payload",), b"x"), StringStartsWith(("target_uri",), "http://h/3")])) \
        == [EqualTo(("payload",), b"x")]
    assert len(reader.partitions()) > 1
    found = [row for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()]
    assert [r["target_uri"] for r in found] == ["http://h/3"]
    slim = warc.read_archive(spark, path, payload=False).where("record_type = 'response'").collect()
    assert len(slim) == 4 and all(r.payload is None for r in slim)
    assert warc.read_archive(spark, path).where("payload_bytes > 100").count() == 0


# ---------------------------------------------------------------- 7 winnowing

def signed(x):
    return x - (1 << 64) if x >> 63 else x


def winnow(text, k=winnowing.K, size=winnowing.WINDOW):
    w = words(text)
    if not w:
        return []
    if len(w) < k:
        return [(0, signed(xxhash.xxh64_intdigest(" ".join(w).encode(), 42)))]
    grams = []
    for i in range(len(w) - k + 1):
        h = 42
        for x in w[i:i + k]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        grams.append(signed(h))
    picked = set()
    for i in range(max(1, len(grams) - size + 1)):
        span = range(i, min(len(grams), i + size))
        least = min(grams[j] >> 30 for j in span)
        picked.add(max(j for j in span if grams[j] >> 30 == least))
    return [(p, grams[p]) for p in sorted(picked)]


def alike(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing(edge):
    key = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    data = sorted(((i, t or "") for i, t in rows_of(edge)), key=lambda r: (r[0] is not None, r[0] or 0, key(r[1])))
    shown = lambda f: ",".join(f"{h & (2**64 - 1):x}@{p}" for p, h in f)
    want = Counter()
    for k, (i, t) in enumerate(data):
        after = data[(k + 1) % len(data)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        a, b = winnow(t), winnow(edited)
        want[(i, len(t), edited, shown(a), shown(b), round(alike(a, b), 9), round(alike(a, winnow(after)), 9))] += 1
    got = winnowing.fingerprints(edge).collect()
    assert bag((r.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_winnowing_guarantee(spark):
    run = " ".join(f"w{k}" for k in range(winnowing.K + winnowing.WINDOW - 1))
    docs = spark.createDataFrame([(1, "a b c d " + run + " e f"), (2, run), (3, "z " * 30 + run)], "doc_id long, text string")
    marks = {r.doc_id: {x.split("@")[0] for x in r.fingerprint.split(",")} for r in winnowing.fingerprints(docs).collect()}
    assert marks[1] & marks[2] and marks[2] & marks[3] and marks[1] & marks[3]
    assert winnowing.fingerprints(docs.where("doc_id = 1")).first().near_next == 1.0  # a single row is its own next


# ---------------------------------------------------------------- 8 mixing

def test_budgets_redistribute_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "_l0 string, _l1 string, _tokens long")
    got = mixing.leaf_budgets(leaves, ["top", "leaf"], 1600, 1, {"top": {"a": 1, "b": 1}, "leaf": {"x": 1, "y": 1}})
    # a/x can give 100 of its 400: its sibling takes the rest, b is not touched
    assert {(r._l0, r._l1): r._budget for r in got.collect()} == {("a", "x"): 100, ("a", "y"): 700, ("b", "x"): 400, ("b", "y"): 400}
    more = mixing.leaf_budgets(leaves, ["top", "leaf"], 2800, 1, {"top": {"a": 1, "b": 1}, "leaf": {"x": 1, "y": 1}})
    # the whole of a gives 1100: only what it cannot use goes to b
    assert {(r._l0, r._l1): r._budget for r in more.collect()} == {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 850, ("b", "y"): 850}


def test_mixing_takes_epochs_and_prefixes(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "g1" if k < 150 else "g2") for k in range(200)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"source": F.col("source")}, budget=700, weights={"source": {"g1": 0.25, "g2": 0.75}}, max_epochs=3).collect()
    total = {g: sum(k % 7 + 1 for k in range(200) if (k < 150) == (g == "g1")) for g in ("g1", "g2")}
    got = Counter()
    for r in out:
        got[r.source] += r.n_tokens
    assert abs(got["g1"] - 175) <= 4 and abs(got["g2"] - 525) <= 4 and total["g2"] < 525
    copies = Counter(r.doc_id for r in out)
    assert {copies[k] for k in range(150, 200)} <= {525 // total["g2"], 525 // total["g2"] + 1}
    again = mixing.mix(docs, {"source": F.col("source")}, budget=700, weights={"source": {"g1": 0.25, "g2": 0.75}}, max_epochs=3).collect()
    assert bag(out) == bag(again)  # seeded


def test_mixing_edges(edge):
    out = mixing.mix(edge, mixing.document_levels())
    assert [c for c in out.columns if c not in ("epoch", "n_tokens")] == [c for c in edge.columns if c != "epoch"]
    rows = out.collect()
    have = Counter(rows_of(edge))
    for key, n in Counter((r.doc_id, r.text) for r in rows).items():
        assert n <= 2 * have[key]
    assert abs(sum(r.n_tokens for r in rows) - sum(len(words(t)) for _, t in rows_of(edge))) <= 30_000


# ---------------------------------------------------------------- 9 SimHash

def simhash_of(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, ids):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(prints))], len({find(k) for k in range(len(prints))})


def test_simhash(edge):
    data = rows_of(edge)
    prints = [simhash_of(t) for _, t in data]
    least, groups = linked(prints, [i for i, _ in data])
    want = bag((i, f"{p:016x}", c) for (i, _), p, c in zip(data, prints, least))
    got = simhash.near_duplicates(edge).collect()
    assert bag((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    assert kept.count() == groups  # also where groups share a smallest id or have none


def test_unrelated_texts_of_one_id_all_stay(spark):
    texts = [" ".join(f"{x}{k}" for k in range(40)) for x in "abcd"]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[3])],
                                 "doc_id long, text string")
    assert bag(rows_of(simhash.keep_first(docs))) == bag([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])])


def test_links_of_crowded_buckets(spark, monkeypatch):
    from segment_lab.llm.graph import components
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (int(c) << 60) for a, b, c in rng.integers(0, 60, (300, 3)) % [60, 60, 3]}
                    | {int(x) for x in rng.integers(0, 2**62, 200)})
    prints = [signed(p & (2**64 - 1)) for p in prints]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want, _ = linked([p & (2**64 - 1) for p in prints], prints)
    for limit in (2, 64, 10_000):
        monkeypatch.setattr(simhash, "SMALL_BUCKET", limit)
        root = {r.node: r.root for r in components(simhash.links(df)).collect()}
        assert [root.get(p, p) for p in prints] == want


def test_golay_code_is_perfect():
    table = simhash.golay_index()
    assert (np.bincount(table) == 2048).all() and len(set(table.tolist())) == 4096


def test_xxh64_slices():
    from segment_lab.llm.xxh import xxh64_slices
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    s = rng.integers(0, 3000, 1500)
    e = s + rng.integers(0, 700, 1500)
    assert xxh64_slices(data, s, e, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(s, e)]


def test_components_of_long_chains(spark):
    from segment_lab.llm.graph import components
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 200: 100}


# ---------------------------------------------------------------- 10 licences

def test_license_base_places(spark, edge):
    more = spark.createDataFrame([
        (100, "MIT license and mit LICENSE; the Apache-License"), (101, "GNU General Public License v3"), (102, "mit"),
        (103, "This work is licensed under the GNU General Public License, version 3."),
        (104, "Licensed under CC BY-NC 4.0."), (104, "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License."),
        (105, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"),
        (106, "licensed under the apache")], "doc_id long, text string")
    both = edge.select("doc_id", "text").union(more)
    got = licenses.scan(both).collect()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = Counter()
    for i, t in rows_of(both):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        want[(i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))] += 1
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    labels = defaultdict(set)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        labels[r.doc_id].add(r.labels)
    assert labels[104] == {"cc-by-nc"} and labels[105] == {"mit"} and labels[106] == {""} and labels[103] == {"gpl"}


# ---------------------------------------------------------------- empty tables

def test_empty_tables(spark, nothing):
    assert packing.pack_documents(nothing, vocabulary()).count() == 0
    assert substrings.remove_repeats(nothing).count() == 0
    assert quality.judge(nothing, None).count() == 0
    assert language.identify(nothing).count() == 0 and language.keep_identified(nothing).count() == 0
    assert byte_repeats.remove_repeats(nothing).count() == 0 and byte_repeats.keep_unrepeated(nothing).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert winnowing.fingerprints(nothing).count() == 0
    assert mixing.mix(nothing, mixing.document_levels()).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0
    assert licenses.scan(nothing).count() == 0


# ---------------------------------------------------------------- words of the tokenizer

def test_remembered_words_equal_whole_texts(monkeypatch):
    """Random texts of letters, marks, digits and special tokens, with a memory of a few words."""
    import random
    from tokenizers import Tokenizer
    fixed, rng = Tokenizer.from_file(vocabulary()), random.Random(9)
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 40)
    letters = "aB'sé.,!?-#*<|>́İΣ1٣日  \n\t 'trevlmdẞŉक़가"
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", " It's. "])
        want = np.array(fixed.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.token_bytes([text], vocabulary()) == [want], text
