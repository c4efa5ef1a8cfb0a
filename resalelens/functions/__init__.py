"""Column-expression helpers used by the operators."""

from resalelens.functions.binning import bin_bounds, bin_label, bin_ordinal
from resalelens.functions.numeric import percent, ratio, to_double
from resalelens.functions.text import (
    lease_years,
    money,
    replace_first,
    rewrite_all,
    rewrite_column,
    rewrite_first,
    split_names,
    storey_low,
    unit_suffix,
)

__all__ = [
    "bin_bounds", "bin_label", "bin_ordinal", "percent", "ratio", "to_double",
    "lease_years", "money", "replace_first", "rewrite_all", "rewrite_column", "rewrite_first",
    "split_names", "storey_low", "unit_suffix",
]
