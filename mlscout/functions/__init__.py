from mlscout.functions.hashing import HASH_RANGE, row_hash
from mlscout.functions.ordering import exact_quantiles, lowest_per_group, prefix_sums
from mlscout.functions.text import html_escape, neutralise_formula, number_text, pseudonymise

__all__ = [
    "HASH_RANGE",
    "exact_quantiles",
    "html_escape",
    "lowest_per_group",
    "neutralise_formula",
    "number_text",
    "prefix_sums",
    "pseudonymise",
    "row_hash",
]
