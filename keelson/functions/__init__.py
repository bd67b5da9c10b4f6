"""Scalar functions as Column expressions; all run inside generated code."""

from keelson.functions.numeric import edge_weight, entropy_term, height_penalty, normalized_overage, rank_of, severity, squared_cv
from keelson.functions.text import (
    basename, basename_stem, common_prefix_length, glob_to_regex, jaccard, manifest_dir, matches_language, mirror_regex, name_tokens,
    normalize_join, path_segments, physical_directory, physical_namespace, real_key, search_tokens,
)

__all__ = [
    "basename", "basename_stem", "common_prefix_length", "edge_weight", "entropy_term", "glob_to_regex", "height_penalty", "jaccard",
    "manifest_dir", "matches_language", "mirror_regex", "name_tokens", "normalize_join", "normalized_overage", "path_segments",
    "physical_directory", "physical_namespace", "rank_of", "real_key", "search_tokens", "severity", "squared_cv",
]
