"""Joins of many rows with a table of one row a key, whatever the sizes of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of so many rows at most is broadcast.
BROADCAST_ROWS = 50_000
#: Larger ones are repeated so often, and the rows of one key dealt to that many parts.
SALTS = 16


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left", most: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key; the key's column stays once.

    The table is counted first, but only up to ``most``.  Beyond that both sides are shuffled, and a key with a great
    share of the rows is spread over ``salts`` tasks.
    """
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key, how)
    # Maps have no hash; a row's other columns are enough to spread the rows of a key.
    hashed = [F.col("`" + f.name.replace("`", "``") + "`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = rows.withColumn("tm_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)))
    each = table.withColumn("tm_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(each, [key, "tm_salt"], how).drop("tm_salt")
