"""Fix where in a plan expensive columns are computed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, *names: str) -> DataFrame:
    """Compute these columns here, once.

    Catalyst moves filters below projections by copying the expressions of the columns they
    use, and with them everything those are made of. For long array expressions the copies grow
    without bound. Columns that come out of a generator stay where they are.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))
