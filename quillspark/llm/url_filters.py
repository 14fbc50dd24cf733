"""URL verdicts: rules for hosts and paths, and a path-template tree per host where no rule fits.

* Rules are looked up once for each distinct host (all its suffixes, by one join); a page then
  takes the longest of its host's rules whose path its own begins with.
* What the rules say of pages are the labels of the templates. Each distinct (host, path) goes
  into three trees: its host's, its site's (the last two labels) and that of all hosts.
* A tree grows level by level. Numbers, with or without a suffix, and long hexadecimals are
  variable and become wildcards of their kind. Where a node has over `fan` children left, words
  with less than 1/fan of its pages are variable too and become wildcards, with or without a
  suffix. So a node has at most fan literal children and five wildcards, however many pages a
  host has.
* Templates that differ in one segment are merged where their shares of blocked pages don't
  differ significantly: siblings in order of their shares are cut where two neighbours do.
* The purity of a template is its share of blocked pages, smoothed towards that of the site's
  template, which is smoothed towards that of all hosts' template; this is smoothed along its
  own path, node by node from the root. Templates of at least `reject` are blocked.

All of it is joins and aggregations; tables of nodes and templates are small, and a join with a
hot host is split by adaptive execution where they aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import staged

#: Fixed values: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEPTH, FAN, WEIGHT, REJECT = 4, 16, 8, 0.5
#: The square of the normal deviate beyond which two shares differ.
APART = 1.96 * 1.96
VARIABLE = [("^[0-9]+\\z", "{n}"), ("^[0-9]+[.][^.]+\\z", "{n}.*"), ("^[0-9A-Fa-f-]{8,}\\z", "{x}")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies after the first :// up to /, ?, # (A-Z lower-cased), and then up to ? or #; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(authority, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(authority) + 1, F.length(rest)), "^[^?#]*", 0)


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, host, path) with the longest rule that fits and its verdict, or nulls; rules: (verdict, host, path).

    Of rules of one length that of the longer host counts, then a block.
    """
    parts = F.split("host", "[.]")
    suffixes = pages.select("host").distinct().select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("says")).distinct()
    rank = F.struct((-F.length(F.concat("suffix", "start"))).alias("a"), (-F.length("suffix")).alias("b"), (F.col("says") != "block").alias("c"), "suffix", "start", "says")
    of_host = suffixes.join(r, "suffix").groupBy("host").agg(F.array_sort(F.collect_list(rank)).alias("own"))
    of_host = staged(of_host, "host-rules")  # apart from the pages' own shuffle, so that a hot host can be split or all hosts be broadcast
    fits = F.filter("own", lambda x: F.startswith(F.col("path"), x["start"]))
    first = F.when(F.size(fits) > 0, F.element_at(fits, 1))
    found = pages.join(of_host, "host", "left").withColumn("__r", first)
    return found.select("page_id", "host", "path", F.concat("__r.suffix", "__r.start").alias("rule"), F.col("__r.says").alias("verdict"))


def _token(segment: Column) -> Column:
    """A wildcard for a number or hexadecimal, else the segment itself after =."""
    out = F.concat(F.lit("="), segment)
    for pattern, kind in reversed(VARIABLE):
        out = F.when(F.rlike(segment, F.lit(pattern)), kind).otherwise(out)
    return out


def grown(paths: DataFrame, depth: int, fan: int) -> tuple[DataFrame, int]:
    """paths (host, path, n, a, b) in their three trees: way, tree, host, path, tokens (of the template), n, a, b; and the most tokens of any."""
    own = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _token)
    segments = F.when(F.size(own) > depth, F.concat(F.slice(own, 1, depth), F.array(F.lit("**")))).otherwise(own)
    trees = F.array(*(F.struct(F.lit(w).alias("way"), t.alias("tree")) for w, t in (("host", F.col("host")), ("site", F.substring_index("host", ".", -2)), ("all", F.lit("*")))))
    at = staged(paths.select("*", F.inline(trees)).select("way", "tree", "host", "path", segments.alias("segments"), F.array().cast("array<string>").alias("tokens"), "n", "a", "b"), "grown")
    deepest = at.agg(F.max(F.size("segments"))).first()[0] or 0
    for k in range(deepest):
        here = F.get("segments", F.lit(k))
        children = at.where(here.isNotNull()).groupBy("way", "tree", "tokens", here.alias("segment")).agg(F.sum("n").alias("c"))
        nodes = children.groupBy("way", "tree", "tokens").agg(F.count("*").alias("different"), F.sum("c").alias("all")).where(F.col("different") > fan)
        often = children.join(nodes, ["way", "tree", "tokens"]).groupBy("way", "tree", "tokens").agg(F.collect_list(F.when(F.col("c") * fan >= F.col("all"), F.col("segment"))).alias("often"))
        often = staged(often, "often")  # as with the templates
        word = F.col("often").isNotNull() & here.startswith("=") & ~F.array_contains("often", here)
        token = F.when(word, F.when(F.contains(here, F.lit(".")), "{w}.*").otherwise("{w}")).otherwise(here)
        grown_ = at.join(often, ["way", "tree", "tokens"], "left").withColumn("tokens", F.when(here.isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array(token)))).drop("often")
        at = staged(grown_.select(at.columns), "grown")
    return at.drop("segments"), deepest


def merged(templates: DataFrame, deepest: int, apart: float = APART) -> DataFrame:
    """templates (way, tree, tokens of at most `deepest`, a, b) with to: the tokens of the template that each is merged into, and the sums of a and b over it."""
    at = templates.withColumn("to", F.col("tokens"))
    for k in reversed(range(deepest)):
        key = ["way", "tree", "to"]
        sums = at.groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        own, n, b = F.get("to", F.lit(k)), F.col("a") + F.col("b"), F.col("b")
        siblings = sums.where(own.isNotNull() & (n > 0)).withColumn("rest", F.transform("to", lambda t, i: F.when(i == k, "").otherwise(t)))
        order = Window.partitionBy("way", "tree", "rest").orderBy(b / n, "to")
        n0, b0 = F.lag(n).over(order), F.lag(b).over(order)
        p = (b + b0) / (n + n0)
        gap = b / n - b0 / n0
        cut = F.when(gap * gap > F.lit(apart) * p * (1 - p) * (1 / n + 1 / n0), 1).otherwise(0)
        islands = siblings.withColumn("cut", cut).withColumn("island", F.sum("cut").over(order))
        group = Window.partitionBy("way", "tree", "rest", "island")
        names = F.array_join(F.array_sort(F.collect_list(own).over(group)), "|")
        joined = islands.withColumn("name", names).select(*key, F.transform("to", lambda t, i: F.when(i == k, F.col("name")).otherwise(t)).alias("next"))
        at = staged(at.join(joined, key, "left").withColumn("to", F.coalesce("next", "to")).drop("next"), "merged")
    total = at.groupBy("way", "tree", "to").agg(F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))
    return at.join(total, ["way", "tree", "to"])


def along_the_path(templates: DataFrame, weight: float) -> DataFrame:
    """(to, purity) of the merged templates (to, sum_a, sum_b) of one tree: each node's share smoothed towards that of the node before."""
    own = templates.select("to", "sum_a", "sum_b").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.size("to")))).withColumn("node", F.slice("to", F.lit(1), F.col("k")))
    nodes = own.groupBy("node").agg(F.sum("sum_a").alias("a"), F.sum("sum_b").alias("b"))
    way = own.select("to", "k", "node").join(nodes, "node").groupBy("to").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b"))).alias("way"))
    root, w = F.element_at("way", 1), F.lit(float(weight))
    purity = F.aggregate(F.slice("way", F.lit(2), F.size("way")), (root["b"] + 1) / (root["a"] + root["b"] + 2), lambda p, x: (x["b"] + w * p) / (x["a"] + x["b"] + w))
    return way.select("to", purity.alias("purity"))


def judged(pages: DataFrame, rules: DataFrame, depth: int = DEPTH, fan: int = FAN, weight: float = WEIGHT, reject: float = REJECT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each page.

    rule is the host and path of the longest rule that fits, verdict its verdict; where none
    fits rule is null and the verdict that of the page's template. Paths of over `depth`
    segments end in one segment **. weight: how many pages the smoothing counts for.

    Null urls and those without :// have empty hosts and paths, whose template is judged like any
    other. Urls of any length are read whole. Repeated rows give repeated rows and count as
    often; an empty table gives an empty result; other columns are ignored. Without any label
    the purity is 1/2 everywhere.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    known = staged(ruled(own, rules), "ruled")
    paths = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    trees, deepest = grown(paths, depth, fan)
    templates = merged(trees.groupBy("way", "tree", "tokens").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), deepest).select("way", "tree", "tokens", "to", "sum_a", "sum_b")
    of_all = along_the_path(templates.where("way = 'all'"), weight).withColumn("way", F.lit("all"))
    # Written first, so that its size is known: templates of a hot host are broadcast if they are small, else their join is split.
    templates = staged(templates.join(of_all, ["way", "to"], "left"), "templates")
    found = trees.select("way", "tree", "host", "path", "tokens").join(templates, ["way", "tree", "tokens"])
    of = lambda way, c: F.max(F.when(F.col("way") == way, F.col(c)))
    scored = found.groupBy("host", "path").agg(*(of(w, f"sum_{c}").alias(f"{w}_{c}") for w in ("host", "site") for c in "ab"), of("host", "to").alias("to"), of("all", "purity").alias("purity"))
    for way in ("site", "host"):
        scored = scored.withColumn("purity", (F.col(f"{way}_b") + F.lit(float(weight)) * F.col("purity")) / (F.col(f"{way}_a") + F.col(f"{way}_b") + F.lit(float(weight))))
    scored = scored.select("host", "path", "purity", F.concat(F.col("host"), F.lit("/"), F.array_join("to", "/")).alias("template"))
    return known.join(scored, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def rules_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(verdict, host, path) rows."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def oracle_sql(rules: list[tuple[str, str, str]] = RULES, depth: int = DEPTH, fan: int = FAN, weight: float = WEIGHT, reject: float = REJECT) -> str:
    """judged() over pages in DuckDB's SQL, without purity."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    token = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for p, k in VARIABLE)
    steps, at = [], "tree0"
    for k in range(1, depth + 2):
        steps.append(f"""
child{k} AS (SELECT way, tree, tokens, segments[{k}] AS s, sum(n) AS c FROM {at} WHERE len(segments) >= {k} GROUP BY ALL),
wide{k} AS (SELECT way, tree, tokens, sum(c) AS total FROM child{k} GROUP BY ALL HAVING count(*) > {fan}),
var{k} AS (SELECT way, tree, tokens, s, CASE WHEN contains(s, '.') THEN '{{w}}.*' ELSE '{{w}}' END AS token FROM child{k} JOIN wide{k} USING (way, tree, tokens) WHERE c * {fan} < total AND starts_with(s, '=')),
tree{k} AS (SELECT t.* REPLACE (CASE WHEN len(segments) < {k} THEN t.tokens ELSE list_append(t.tokens, coalesce(v.token, segments[{k}])) END AS tokens)
  FROM {at} AS t LEFT JOIN var{k} AS v ON v.way = t.way AND v.tree = t.tree AND v.tokens = t.tokens AND v.s = t.segments[{k}])""")
        at = f"tree{k}"
    steps.append(f"""
merge{depth + 2} AS (SELECT way, tree, tokens, tokens AS onto, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM {at} GROUP BY ALL)""")
    for k in range(depth + 1, 0, -1):
        steps.append(f"""
sum{k} AS (SELECT way, tree, onto, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM merge{k + 1} GROUP BY ALL),
sib{k} AS (SELECT *, onto[{k}] AS own, onto[:{k - 1}] AS before, onto[{k + 1}:] AS after, a + b AS n, b / (a + b) AS share FROM sum{k} WHERE len(onto) >= {k} AND a + b > 0),
lag{k} AS (SELECT *, lag(n) OVER o AS n0, lag(b) OVER o AS b0 FROM sib{k} WINDOW o AS (PARTITION BY way, tree, before, after ORDER BY share, own)),
cut{k} AS (SELECT *, CASE WHEN (share - b0 / n0) * (share - b0 / n0) > {APART!r}::DOUBLE * ((b + b0) / (n + n0)) * (1 - (b + b0) / (n + n0)) * (1 / n + 1 / n0) THEN 1 ELSE 0 END AS cut FROM lag{k}),
isl{k} AS (SELECT *, sum(cut) OVER (PARTITION BY way, tree, before, after ORDER BY share, own) AS island FROM cut{k}),
name{k} AS (SELECT way, tree, before, after, island, string_agg(own, '|' ORDER BY own) AS name FROM isl{k} GROUP BY ALL),
merge{k} AS (SELECT m.* REPLACE (CASE WHEN x.name IS NULL THEN m.onto ELSE list_concat(list_append(m.onto[:{k - 1}], x.name), m.onto[{k + 1}:]) END AS onto)
  FROM merge{k + 1} AS m LEFT JOIN isl{k} AS i ON i.way = m.way AND i.tree = m.tree AND i.onto = m.onto LEFT JOIN name{k} AS x ON x.way = i.way AND x.tree = i.tree AND x.before = i.before AND x.after = i.after AND x.island = i.island)""")
    return f"""
WITH RECURSIVE rules(says, rhost, rpath) AS (VALUES {values}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cutup AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest),
parsed AS (SELECT page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cutup),
pairs AS (SELECT DISTINCT host, path FROM parsed),
fits AS (SELECT host, path, first({{'rule': rhost || rpath, 'says': says}} ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, says DESC) AS r
  FROM pairs JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
known AS (SELECT page_id, p.host, p.path, r.rule AS rule, r.says AS verdict FROM parsed AS p LEFT JOIN fits AS f ON f.host = p.host AND f.path = p.path),
paths AS (SELECT host, path, count(*) AS n, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE {token} ELSE '=' || s END) AS own FROM known GROUP BY ALL),
tree0 AS (SELECT t.way, t.tree, host, path, CASE WHEN len(own) > {depth} THEN list_append(own[:{depth}], '**') ELSE own END AS segments, []::VARCHAR[] AS tokens, n, a, b
  FROM (SELECT *, unnest([{{'way': 'host', 'tree': host}}, {{'way': 'site', 'tree': array_to_string(string_split(host, '.')[-2:], '.')}}, {{'way': 'all', 'tree': '*'}}]) AS t FROM paths)),
{",".join(steps)},
total AS (SELECT way, tree, onto, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM merge1 GROUP BY ALL),
found AS (SELECT t.host, t.path, t.way, m.onto, x.a, x.b FROM {at} AS t JOIN merge1 AS m USING (way, tree, tokens) JOIN total AS x USING (way, tree, onto)),
own AS (SELECT DISTINCT onto, a, b, unnest(range(0, len(onto) + 1)) AS k FROM total WHERE way = 'all'),
node AS (SELECT onto[:k] AS at, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM own GROUP BY ALL),
along(onto, k, p) AS (SELECT DISTINCT o.onto, 0::BIGINT, (n.b + 1) / (n.a + n.b + 2) FROM own AS o JOIN node AS n ON len(n.at) = 0
  UNION ALL SELECT c.onto, k + 1, (n.b + {float(weight)}::DOUBLE * p) / (n.a + n.b + {float(weight)}::DOUBLE) FROM along AS c JOIN node AS n ON n.at = c.onto[:k + 1] WHERE k < len(c.onto)),
all1 AS (SELECT host, path, p FROM found JOIN along ON along.onto = found.onto AND along.k = len(found.onto) WHERE way = 'all'),
site1 AS (SELECT f.host, f.path, (b + {float(weight)}::DOUBLE * p) / (a + b + {float(weight)}::DOUBLE) AS p FROM found AS f JOIN all1 AS g ON g.host = f.host AND g.path = f.path WHERE way = 'site'),
host1 AS (SELECT f.host, f.path, f.onto, (b + {float(weight)}::DOUBLE * p) / (a + b + {float(weight)}::DOUBLE) AS p FROM found AS f JOIN site1 AS g ON g.host = f.host AND g.path = f.path WHERE way = 'host')
SELECT page_id, k.host, k.path, rule, coalesce(verdict, CASE WHEN p >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, k.host || '/' || array_to_string(onto, '/') AS template
FROM known AS k JOIN host1 AS h ON h.host = k.host AND h.path = k.path
"""
