"""A view of offers over the part table, for running offer operators on generated data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The same view in SQL, as a common table expression named ``offers``.
SQL = """offers AS (SELECT p_partkey AS offer_id, p_brand AS restaurant, concat('City', cast(p_size % 7 AS varchar)) AS city,
    concat(CASE p_partkey % 6 WHEN 0 THEN concat(cast(10 + p_partkey % 40 AS varchar), '% off ')
        WHEN 1 THEN concat('$', cast(cast(floor(p_retailprice / 100) AS bigint) AS varchar), ' ')
        WHEN 2 THEN 'BOGO ' WHEN 3 THEN 'Happy hour ' WHEN 4 THEN 'Free ' ELSE '' END, p_name,
        CASE p_partkey % 4 WHEN 0 THEN ' special every Tuesday' WHEN 1 THEN ' Mon-Fri 3-6 pm' WHEN 2 THEN ' daily' ELSE '' END) AS summary,
    33.6 + (p_partkey % 100) * 0.002::double AS latitude, -118.0 + (p_partkey % 70) * 0.003::double AS longitude,
    p_retailprice AS price FROM part)"""


def offers(part: DataFrame) -> DataFrame:
    """One offer a part: (offer_id, restaurant, city, summary, latitude, longitude, price)."""
    key = F.col("p_partkey")
    text = lambda n: n.cast("string")
    lead = (
        F.when(key % 6 == 0, F.concat(text(10 + key % 40), F.lit("% off ")))
        .when(key % 6 == 1, F.concat(F.lit("$"), text(F.floor(F.col("p_retailprice") / 100).cast("bigint")), F.lit(" ")))
        .when(key % 6 == 2, "BOGO ")
        .when(key % 6 == 3, "Happy hour ")
        .when(key % 6 == 4, "Free ")
        .otherwise("")
    )
    tail = F.when(key % 4 == 0, " special every Tuesday").when(key % 4 == 1, " Mon-Fri 3-6 pm").when(key % 4 == 2, " daily").otherwise("")
    return part.select(
        key.alias("offer_id"),
        F.col("p_brand").alias("restaurant"),
        F.concat(F.lit("City"), text(F.col("p_size") % 7)).alias("city"),
        F.concat(lead, F.col("p_name"), tail).alias("summary"),
        (F.lit(33.6) + (key % 100) * F.lit(0.002)).alias("latitude"),
        (F.lit(-118.0) + (key % 70) * F.lit(0.003)).alias("longitude"),
        F.col("p_retailprice").alias("price"),
    )
