"""A register derived from order tables, so that every analysis runs at any scale.

Orders are records, their lines mentions, and a part and a sex a person. `SQL` says the
same for an SQL engine over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.linkage import relation_rules, relations_of
from quillspark.plans.analytics import Register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENTS = """
SELECT o_orderkey AS record_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'birth' WHEN 1 THEN 'marriage' ELSE 'death' END AS type,
  CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN substring({day}, 1, 4) WHEN 2 THEN substring({day}, 1, 7) ELSE {day} END AS date,
  CASE o_orderkey % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'year' WHEN 2 THEN 'month' ELSE 'day' END AS date_precision,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(substring({day}, 1, 4) AS INT) END AS year,
  concat('P', CAST(o_custkey % 23 AS {text})) AS place_text
FROM orders
"""
MENTIONS = """
SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS id, l_orderkey AS record_id, role,
  concat('given', CAST(l_suppkey % 20 AS {text})) AS given_norm,
  CASE WHEN l_partkey % 9 = 0 THEN '' ELSE concat('name', CAST(l_partkey % 50 AS {text})) END AS surname_norm,
  CASE WHEN sex = 'f' AND l_partkey % 4 = 0 THEN concat('name', CAST(l_suppkey % 50 AS {text})) ELSE '' END AS maiden_norm,
  sex, concat('P', CAST(l_suppkey % 17 AS {text})) AS place_text,
  CASE WHEN role = 'zenich' AND l_returnflag = 'R' THEN 'vdovec' WHEN role = 'nevesta' AND l_returnflag = 'R' THEN 'vdova'
    WHEN role = 'dite' AND l_returnflag = 'N' THEN 'manzelsky' WHEN role = 'dite' AND l_returnflag = 'A' THEN 'nemanzelsky'
    ELSE '' END AS marital_status,
  l_partkey * 2 + CASE WHEN sex = 'f' THEN 1 ELSE 0 END AS person_id
FROM (SELECT *, CASE WHEN role IN ('matka', 'nevesta', 'nevesta_matka', 'zemrely_matka', 'kmotr') THEN 'f'
    WHEN role IN ('dite', 'zemrely') AND l_suppkey % 2 = 0 THEN 'f' ELSE 'm' END AS sex
  FROM (SELECT *, CASE l_orderkey % 3
      WHEN 0 THEN CASE l_linenumber WHEN 1 THEN 'otec' WHEN 2 THEN 'matka' WHEN 3 THEN 'dite' ELSE 'kmotr' END
      WHEN 1 THEN CASE l_linenumber WHEN 1 THEN 'zenich' WHEN 2 THEN 'nevesta' WHEN 3 THEN 'zenich_otec' WHEN 4 THEN 'nevesta_matka' ELSE 'svedek' END
      ELSE CASE l_linenumber WHEN 1 THEN 'zemrely' WHEN 2 THEN 'zemrely_otec' WHEN 3 THEN 'zemrely_matka' ELSE 'svedek' END END AS role
    FROM lineitem) AS a) AS b
"""
PERSONS = """
SELECT p_partkey * 2 + s AS id, concat(p_name, CASE s WHEN 1 THEN ' f' ELSE ' m' END) AS display_name,
  CASE s WHEN 1 THEN 'f' ELSE 'm' END AS sex,
  CASE WHEN p_partkey % 7 <> 0 THEN 1920 + p_size END AS birth_year_est,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(1920 + p_size + p_partkey % 120 AS INT) END AS death_year_est
FROM (SELECT *, {both} AS s FROM part) AS x
"""


def register(spark: SparkSession, sf_dir: str) -> Register:
    """The register of the tables at sf_dir."""
    day = {"day": "date_format(o_orderdate, 'yyyy-MM-dd')", "text": "STRING", "both": "explode(array(0, 1))"}
    orders, lineitem, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    events = spark.sql(EVENTS.format(**day).replace("FROM orders", "FROM {orders}"), orders=orders)
    mentions = spark.sql(MENTIONS.format(**day).replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    persons = spark.sql(PERSONS.format(**day).replace("FROM part", "FROM {part}"), part=part)
    links = mentions.select("person_id", F.col("id").alias("mention_id"))
    return Register(events, mentions.drop("person_id"), persons, links, relations_of(mentions.groupBy("record_id", "role").agg(F.max_by("person_id", "id").alias("person_id"))), scans=orders, records=orders, books=table(spark, sf_dir, "customer"))


_DUCK = {"day": "strftime(o_orderdate, '%Y-%m-%d')", "text": "VARCHAR", "both": "unnest([0, 1])"}
#: The same tables as common table expressions, to put before a query.
SQL = f"""WITH reg_events AS ({EVENTS.format(**_DUCK)}),
reg_all AS ({MENTIONS.format(**_DUCK)}),
reg_mentions AS (SELECT * EXCLUDE (person_id) FROM reg_all),
reg_links AS (SELECT person_id, id AS mention_id FROM reg_all),
reg_persons AS ({PERSONS.format(**_DUCK)}),
rules(type, role_a, role_b) AS (VALUES {", ".join(str(r) for r in relation_rules())}),
roles AS (SELECT record_id, role, arg_max(person_id, id) AS person_id FROM reg_all GROUP BY ALL),
found AS (SELECT type, a.person_id AS pa, b.person_id AS pb, a.record_id FROM rules JOIN roles a ON a.role = role_a
  JOIN roles b ON b.role = role_b AND b.record_id = a.record_id WHERE a.person_id <> b.person_id),
reg_relations AS (SELECT type, CASE WHEN type = 'spouse' THEN least(pa, pb) ELSE pa END AS person_a,
  CASE WHEN type = 'spouse' THEN greatest(pa, pb) ELSE pb END AS person_b, list_sort(list(record_id)) AS evidence FROM found GROUP BY ALL)
"""
