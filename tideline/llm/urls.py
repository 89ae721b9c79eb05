"""URL filters: host and path rules, and gradient-boosted trees for what no rule fits.

The trees learn lexical features of URLs that a rule judges: lengths, depth, digit ratio, entropy, parameter counts, and
statistics of host and path suffixes. The sample they learn from is bounded; the statistics count every labelled URL. All
of it is built-in functions and Spark's own boosted trees.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import materialize

#: Verdict, host, path; fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SAMPLE_ROWS, TREES, DEPTH = 20_000, 12, 4
#: A suffix of at least one in ``COMMON`` of all labelled URLs is looked up without a shuffle; there are at most so many of a kind.
COMMON = 1000
PRIOR = 4.0
CHUNK = 65_536


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host`` and ``path``; both empty for null or where ``://`` is missing."""
    after = F.when(F.instr(F.col(f"`{url}`"), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", lower_ascii(host)).withColumn("path", path)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits, else null; of equal lengths the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in reversed(ordered):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features ``f_*`` to ``urls`` with ``host`` and ``path``; null counts as empty."""
    text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    length = F.length(text)
    runs = F.sequence(F.lit(0), F.floor(length / CHUNK).cast("int"))
    letters = F.flatten(F.transform(runs, lambda i: F.array_distinct(F.split(F.substring(text, i * CHUNK + 1, F.lit(CHUNK)), ""))))
    shown = F.transform(
        F.array_distinct(F.array_remove(letters, "")),
        lambda c: (length - F.length(F.replace(text, c, F.lit("")))) / F.greatest(length, F.lit(1)),
    )
    entropy = F.aggregate(shown, F.lit(0.0), lambda s, p: s - p * F.log2(F.greatest(p, F.lit(1e-12))))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    features = {
        "f_length": length,
        "f_host_length": F.length("host"),
        "f_path_length": F.length("path"),
        "f_depth": F.regexp_count("path", F.lit("/[^/]+")),
        "f_labels": F.regexp_count("host", F.lit(r"[^.]+")),
        "f_digits": F.regexp_count(text, F.lit("[0-9]")) / F.greatest(length, F.lit(1)),
        "f_entropy": entropy,
        "f_parameters": F.regexp_count(query, F.lit("[^&]+")),
        "f_hyphens": F.regexp_count(text, F.lit("-")),
        "f_fragment": (F.instr(text, "#") > 0).cast("int"),
        "f_secure": lower_ascii(F.substring(text, 1, 8)).startswith("https://").cast("int"),
    }
    return urls.withColumns({k: F.coalesce(v, F.lit(0)).cast("double") for k, v in features.items()})


def suffixes() -> dict[str, Column]:
    """What statistics are kept of: the last label and the last two of a host, the first and last part of a path."""
    labels, parts = F.split("host", r"\."), F.array_remove(F.split("path", "/"), "")
    return {
        "s_top": F.element_at(labels, -1),
        "s_site": F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2)),
        "s_first": F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")),
        "s_ending": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/)$", 1),
    }


@dataclass(frozen=True)
class UrlModel:
    """Counts of all suffixes, ``(kind, suffix, n, blocked)``, and of all labelled URLs, and the trees; no trees: the share
    of block among all decides."""

    counts: DataFrame | None
    total: int
    blocked: float
    trees: GBTClassificationModel | None

    @property
    def base(self) -> float:
        return self.blocked / self.total if self.total else 0.0


def _with_shares(urls: DataFrame, model: UrlModel) -> DataFrame:
    """Adds the block share ``f_s_*`` of each suffix, drawn towards the share of all; a suffix never seen has that.

    Common suffixes come from a broadcast of at most ``COMMON`` rows a kind, so a host with a third of all URLs is not
    shuffled by its name; rows that had theirs are spread by digest in the join with all others.
    """
    share = ((F.col("blocked") + PRIOR * model.base) / (F.col("n") + PRIOR)).alias("share")
    for name, suffix in suffixes().items():
        found = urls.withColumn("own", suffix)
        if model.counts is None:
            urls = found.withColumn(f"f_{name}", F.lit(model.base)).drop("own")
            continue
        own = model.counts.where(F.col("kind") == name).select(F.col("suffix").alias("own"), share, "n")
        is_common = F.col("n") * COMMON >= model.total
        common = own.where(is_common).select("own", F.col("share").alias("common"))
        rare = own.where(~is_common).select(F.col("own").alias("key"), F.col("share").alias("rare"))
        found = found.join(F.broadcast(common), "own", "left")
        spread = F.concat(F.lit("\n"), F.pmod(F.xxhash64("host", "path"), F.lit(COMMON)).cast("string"))
        found = found.withColumn("key", F.when(F.col("common").isNull(), F.col("own")).otherwise(spread)).join(rare, "key", "left")
        urls = found.withColumn(f"f_{name}", F.coalesce("common", "rare", F.lit(model.base))).drop("own", "key", "common", "rare")
    return urls


FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_parameters",
    "f_hyphens", "f_fragment", "f_secure", "f_s_top", "f_s_site", "f_s_first", "f_s_ending",
)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, url: str = "url") -> UrlModel:
    """Learns from ``labelled`` with the URL and ``verdict`` (``allow`` or ``block``; others are left out).

    Suffix statistics count all labelled rows and all suffixes. The trees see the ``sample_rows`` rows with the smallest
    digests.
    """
    known = with_parts(labelled.where(F.col("verdict").isin("allow", "block")).select(F.col(f"`{url}`").alias("url"), "verdict"))
    known = known.withColumn("label", (F.col("verdict") == "block").cast("double"))
    stacked = known.select("label", F.explode(F.create_map(*[x for k, v in suffixes().items() for x in (F.lit(k), v)])).alias("kind", "suffix"))
    counts = stacked.groupBy("kind", "suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"))
    counts = materialize(counts, "suffixes")
    whole = counts.where("kind = 's_top'").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    if not whole.n:
        return UrlModel(None, 0, 0.0, None)
    model = UrlModel(counts, whole.n, whole.blocked, None)
    if whole.blocked in (0, whole.n):
        return model
    drawn = known.orderBy(F.xxhash64("url"), "url").limit(sample_rows).select("url", "host", "path", "label")
    ready = _with_shares(with_features(drawn), model).select("label", *FEATURES)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(materialize(ready, "url-features"))
    classifier = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False)
    return replace(model, trees=classifier.fit(assembled.select("label", "features")))


def judge(urls: DataFrame, model: UrlModel, rules: tuple = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns and ``host, path, rule, verdict, score`` of every row; a rule's verdict goes before the model's.

    The score is the model's chance of block, null where a rule fits. Nulls are judged as empty URLs.
    """
    chosen = urls.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{url}`").alias("url"))
    parted = with_parts(chosen).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    kept = [f"k{i}" for i in range(len(keep))]
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    ruled = parted.where("found IS NOT NULL").select(*kept, "host", "path", "found.rule", "found.verdict", F.lit(None).cast("double").alias("score"))
    rest = parted.where("found IS NULL")
    if model.trees is None:
        scored = rest.withColumn("score", F.lit(float(model.base)))
    else:
        ready = _with_shares(with_features(rest).drop("url", "found"), model)
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready)
        scored = model.trees.transform(ready).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    scored = scored.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), "score")
    return ruled.unionByName(scored).select(*named, "host", "path", "rule", "verdict", "score")


def labelled_by_rules(urls: DataFrame, rules: tuple = RULES, url: str = "url") -> DataFrame:
    """The URLs that a rule judges, with its verdict."""
    parted = with_parts(urls.select(F.col(f"`{url}`").alias("url")))
    found = parted.select("url", rule_of(F.col("host"), F.col("path"), rules).alias("found"))
    return found.where("found IS NOT NULL").select("url", "found.verdict")
