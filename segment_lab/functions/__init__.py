from .columns import (flag_filter, select_group, feature_columns, split_types, path_keys,
                      path_rewrite, hour_label, drop_nulls, rescale)
from .randomness import uniform01, seeded_hash
from .special import f_sf, binom_cdf, betainc

__all__ = ["flag_filter", "select_group", "feature_columns", "split_types", "path_keys",
           "path_rewrite", "hour_label", "drop_nulls", "rescale",
           "uniform01", "seeded_hash", "f_sf", "binom_cdf", "betainc"]
