"""Production parameters that queries and the pipeline share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Production mix: half of all tokens, at most two epochs of any source.
MIX_SHARE = 0.5
MIX_SEED = 42
MIX_EPOCHS = 2
MIX_WEIGHTS = {
    "domain": {"web": 5, "books": 3, "code": 2},
    "lang": {"en": 6, "de": 2, "fr": 2},
    "source": {"src0": 2, "src1": 3, "src2": 3},
}


def domain_of_source(source: Column) -> Column:
    """Domain of a source by the last digits of its name."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    kind = F.when(number != "", number.cast("long") % 3)
    return F.when(kind == 0, "web").when(kind == 1, "books").when(kind == 2, "code").otherwise("unknown")
