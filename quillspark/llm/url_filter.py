"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for what no rule fits.

DataFrame and SQL functions only. The trees learn from the URLs that a rule labels: features are cut into bins at
quantiles, and every level of a tree is one aggregate of gradients by (node, feature, bin), so the driver only sees
histograms whose size the parameters bound. A fitted model is a sum of CASE expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

#: (verdict, rule). A rule is a host and the start of a path; it fits the host and its subdomains.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labelled URLs that the model is fitted on, about so many at most.
SAMPLE = 20_000
#: Parts that the fitting rows fall in, to learn each row's statistics from the others.
FOLDS = 4
#: Parts of a url whose labelled copies are counted: last one and two labels of the host, first folder of the path.
STATISTICS = ("suffix1", "suffix2", "segment")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KINDS = [*_LOWER, *"0123456789", "-", ".", "/", "_", "=", "&", "%"]


def parts(pages: DataFrame) -> DataFrame:
    """Adds host and path: empty for a null url and for one without ``://``."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", host).withColumn("path", path)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null; of equally long ones the last named."""
    found = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def verdict_of(rule_: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule_ == text, F.lit(verdict)).otherwise(out)
    return out


def lexical(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the lexical features of url as doubles, and names them."""
    url = F.coalesce("url", F.lit(""))
    low = F.translate(url, _UPPER, _LOWER)
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda c, text: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    p = pages.withColumn("_counts", F.array(*[count(c, low) for c in _KINDS]))
    other = size - F.aggregate("_counts", F.lit(0.0), lambda s, x: s + x)
    terms = F.transform(F.concat("_counts", F.array(other)), lambda n: F.when(n > 0, -(n / size) * F.log2(n / size)).otherwise(F.lit(0.0)))
    of = lambda c: F.element_at("_counts", _KINDS.index(c) + 1)
    digits = sum((of(d) for d in "0123456789"), F.lit(0.0))
    features = {
        "f_length": size,
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_depth": count("/", F.col("path")),
        "f_labels": count(".", F.col("host")),
        "f_hyphens": count("-", F.col("host")),
        "f_digits": digits / size,
        "f_entropy": F.aggregate(terms, F.lit(0.0), lambda s, x: s + x),
        "f_parameters": F.when(F.instr(url, "?") > 0, of("&") + 1).otherwise(F.lit(0.0)),
        "f_values": of("="),
        "f_escapes": of("%"),
        "f_secure": low.startswith("https:").cast("double"),
    }
    p = p.withColumns(features).drop("_counts")
    return p.withColumns({"suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2), "segment": F.regexp_extract("path", "^/([^/]*)/", 1)}), list(features)


class Boosted:
    """Gradient-boosted trees for a 0/1 column y, fitted by histograms."""

    def __init__(self, train: DataFrame, names: list[str], trees: int = 6, depth: int = 3, bins: int = 16, rate: float = 0.4, l2: float = 1.0):
        self.names, self.trees, self.rate = names, [], rate
        marks = train.agg(*[F.percentile_approx(n, [k / bins for k in range(1, bins)], 10_000).alias(n) for n in names], F.count("y").alias("_n"), F.sum("y").alias("_y")).first()
        n, ones = marks["_n"] or 0, float(marks["_y"] or 0)
        self.start = math.log((ones + 0.5) / (n - ones + 0.5))
        if not n or ones in (0.0, float(n)):
            return
        self.cuts = {c: sorted(set(marks[c])) for c in names}
        binned = [sum((F.when(F.col(c) > x, 1).otherwise(0) for x in self.cuts[c]), F.lit(0)).cast("int").alias(c) for c in names]
        # equal rows of bins are one row with two counts
        rows = common.checkpointed(train.select("y", *binned).groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("ones")))
        for _ in range(trees):
            tree: dict[int, tuple | float] = {}
            open_ = [0]
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self._margin(binned=True)))
            graded = rows.select(*names, (F.col("ones") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
            for level in range(depth + 1):
                node = self._node(tree)
                wide = graded.withColumn("node", node).filter(F.col("node").isin(open_))
                sums = wide.select("node", "g", "h", F.posexplode(F.array(*names)).alias("f", "b")).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
                following = []
                for k in open_:
                    own = [s for s in sums if s["node"] == k]
                    g, h = (sum(s[c] for s in own if s["f"] == 0) for c in ("g", "h"))
                    best = (1e-6, None)
                    for f, name in enumerate(names):
                        left_g = left_h = 0.0
                        for s in sorted((s for s in own if s["f"] == f), key=lambda s: s["b"])[:-1]:
                            left_g, left_h = left_g + s["g"], left_h + s["h"]
                            gain = round(left_g**2 / (left_h + l2) + (g - left_g) ** 2 / (h - left_h + l2) - g**2 / (h + l2), 6)
                            if gain > best[0]:
                                best = (gain, (name, s["b"]))
                    if best[1] is None or level == depth:
                        tree[k] = rate * g / (h + l2)
                    else:
                        tree[k] = best[1]
                        following += [2 * k + 1, 2 * k + 2]
                open_ = following
                if not open_:
                    break
            self.trees.append(tree)

    def _node(self, tree: dict, k: int = 0) -> Column:
        if not isinstance(tree.get(k), tuple):
            return F.lit(k)
        name, b = tree[k]
        return F.when(F.col(name) <= b, self._node(tree, 2 * k + 1)).otherwise(self._node(tree, 2 * k + 2))

    def _value(self, tree: dict, binned: bool, k: int = 0) -> Column:
        if not isinstance(tree[k], tuple):
            return F.lit(float(tree[k]))
        name, b = tree[k]
        below = F.col(name) <= b if binned else ~(F.col(name) > self.cuts[name][b])
        return F.when(below, self._value(tree, binned, 2 * k + 1)).otherwise(self._value(tree, binned, 2 * k + 2))

    def _margin(self, binned: bool = False) -> Column:
        return sum((self._value(t, binned) for t in self.trees), F.lit(self.start))

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self._margin()))


def suffix_statistics(train: DataFrame) -> tuple[dict[str, DataFrame], float]:
    """For each of STATISTICS a table (value, ones, n) of the fitting rows, no larger than they are; and the share of ones."""
    ones = train.agg(F.avg("y")).first()[0]
    return {s: train.groupBy(s).agg(F.sum("y").alias(f"f_{s}_ones"), F.count("*").cast("double").alias(f"f_{s}_n")) for s in STATISTICS}, 0.0 if ones is None else float(ones)


def with_suffixes(rows: DataFrame, stats: dict[str, DataFrame], prior: float, own: DataFrame | None = None) -> DataFrame:
    """Adds the share of blocked and the logarithm of the number of labelled URLs with the same parts of STATISTICS.

    own are the fitting rows: where rows has their fold, a row's statistics leave the fitting rows of its fold out, so no
    row's label is among its own features.
    """
    for name, table in stats.items():
        share, n = f"f_{name}_share", f"f_{name}_n"
        rows = rows.join(F.broadcast(table), name, "left").fillna({f"f_{name}_ones": 0.0, n: 0.0})
        if own is not None:
            fold = own.groupBy(name, "fold").agg(F.sum("y").alias("_ones"), F.count("*").alias("_n"))
            rows = rows.join(F.broadcast(fold), [name, "fold"]).withColumn(f"f_{name}_ones", F.col(f"f_{name}_ones") - F.col("_ones")).withColumn(n, F.col(n) - F.col("_n")).drop("_ones", "_n")
        rows = rows.withColumn(share, (F.col(f"f_{name}_ones") + F.lit(prior)) / (F.col(n) + F.lit(1.0))).withColumn(n, F.log1p(n)).drop(f"f_{name}_ones")
    return rows


def sampled(labelled: DataFrame, names: list[str], n: int, sample: int) -> DataFrame:
    """The rows that trees are fitted on: of n labelled ones about sample, drawn by a hash of url and page_id, with their fold."""
    draw = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("page_id", F.lit(-1)))
    some = labelled.filter(F.pmod(draw, F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / n)))
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).alias("fold")
    return common.checkpointed(some.select("page_id", *names, *STATISTICS, fold, F.when(F.col("given") == "block", 1.0).otherwise(0.0).alias("y")))


def fitted(train: DataFrame, names: list[str]) -> tuple[Boosted, dict[str, DataFrame], float]:
    stats, prior = suffix_statistics(train)
    names = [*names, *(f"f_{s}_{x}" for s in stats for x in ("share", "n"))]
    return Boosted(with_suffixes(train, stats, prior, train), names), stats, prior


def filtered(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) of every row of pages (page_id, url).

    The verdict is the longest fitting rule's, else block where the trees give 0.5 or more. The trees are fitted on a
    bounded share of the rows that a rule labels, drawn by a hash of url and page_id; without labels of both kinds everything
    follows the only kind, and allow without any. Null and malformed urls have empty host and path and are judged by
    their features. Repeated rows stay; extra columns are ignored; an empty table stays empty.
    """
    judged = parts(pages.select("page_id", "url"))
    judged = judged.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    rows, names = lexical(judged.withColumn("given", verdict_of(F.col("rule"), rules)))
    n = judged.filter("rule is not null").count()
    if not n:
        return judged.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(0.0).alias("probability"))
    model, stats, prior = fitted(sampled(rows.filter("given is not null"), names, n, sample), names)
    out = with_suffixes(rows, stats, prior).withColumn("probability", model.probability())
    verdict = F.coalesce("given", F.when(F.col("probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "probability")


def op2_url_filter(spark, sf_dir) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
