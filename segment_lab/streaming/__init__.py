from .segments import stream_segments, run_stream_segments

__all__ = ["stream_segments", "run_stream_segments"]
from .counted import run_count_segments  # noqa: F401
