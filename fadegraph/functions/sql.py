"""The kernels as SQL functions of a session: expressions, not Python."""
from __future__ import annotations

from pyspark.sql import SparkSession

from fadegraph.functions.channels import CHANNELS, CUSTOM
from fadegraph.functions.exprs import ACCENTED, OID_NAMESPACE, PLAIN


def register(spark: SparkSession) -> None:
    """Make kg_eff, kg_node_id, kg_fold, kg_fuzzy and kg_cosine known to the session's SQL."""
    rate = " ".join(f"WHEN '{c}' THEN {t[0]}D" for c, t in CHANNELS.items())
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"""{make} kg_eff(intensity DOUBLE, channel STRING, last_touch TIMESTAMP_NTZ, as_of TIMESTAMP_NTZ) RETURNS DOUBLE
      RETURN intensity * exp(-(CASE channel {rate} ELSE {CUSTOM[0]}D END) * greatest(0, timestampdiff(SECOND, last_touch, as_of)) / 3600D)""")
    h = f"sha1(concat(unhex('{OID_NAMESPACE}'), encode(concat(ws, ':', label), 'UTF-8')))"
    spark.sql(f"""{make} kg_node_id(ws STRING, label STRING) RETURNS STRING
      RETURN concat_ws('-', substring({h}, 1, 8), substring({h}, 9, 4), concat('5', substring({h}, 14, 3)),
        concat(lower(hex((cast(conv(substring({h}, 17, 2), 16, 10) AS INT) & 63) | 128)), substring({h}, 19, 2)), substring({h}, 21, 12))""")
    spark.sql(f"{make} kg_fold(t STRING) RETURNS STRING RETURN translate(lower(t), '{ACCENTED}', '{PLAIN}')")
    bare, q = f"translate(lower(label), '{ACCENTED}', '{PLAIN}')", f"translate(lower(trim(query)), '{ACCENTED}', '{PLAIN}')"
    spark.sql(f"""{make} kg_fuzzy(label STRING, query STRING) RETURNS DOUBLE RETURN CASE WHEN trim(query) = '' THEN 0D
      WHEN lower(label) = lower(trim(query)) THEN 1D WHEN octet_length(trim(query)) >= 3 AND {bare} = {q} THEN 0.95D
      WHEN startswith(lower(label), lower(trim(query))) THEN 0.9D WHEN octet_length(trim(query)) >= 3 AND startswith({bare}, {q}) THEN 0.85D
      WHEN contains(lower(label), lower(trim(query))) THEN 0.7D WHEN octet_length(trim(query)) >= 3 AND contains({bare}, {q}) THEN 0.65D ELSE 0D END""")
    dot = "aggregate(zip_with({0}, {1}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    spark.sql(f"""{make} kg_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
      RETURN CASE WHEN sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')}) < 1e-10D THEN 0D
        ELSE {dot.format('a', 'b')} / (sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})) END""")
