"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import ascii_lower

#: Rules up to this many, and up to this many characters, are broadcast as a trie; beyond it rules are joined by key.
MAX_TRIE_RULES, MAX_TRIE_CHARS = 500_000, 32_000_000


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without '://'."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _segments(path: str) -> tuple[list[str], str]:
    """Whole segments, each with the slash that ends it, and the open rest."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]], parts[-1]


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """rules: (verdict, host, path). A node: children by label, by path segment, and the rules that end in it."""
    root: dict = {"labels": {}, "segments": {}, "ends": []}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "segments": {}, "ends": []})
        whole, rest = _segments(path)
        for segment in whole:
            node = node["segments"].setdefault(segment, {"labels": {}, "segments": {}, "ends": []})
        node["ends"].append((rest, (len(host) + len(path), len(host), verdict == "block"), f"{host}{path}", verdict))
    return root


def match(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits and its verdict; of equal length the longer host, then block, wins."""
    best = None
    segments, tail = _segments(path)
    segments.append(tail)
    node = trie
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        at = node
        for depth, segment in enumerate(segments):
            for rest, rank, rule, verdict in at["ends"]:
                if segment.startswith(rest) and (best is None or rank > best[0]):
                    best = (rank, rule, verdict)
            at = at["segments"].get(segment) if depth < len(segments) - 1 else None
            if at is None:
                break
    return (best[1], best[2]) if best else (None, None)


def url_filter(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of df: id_col, host, path, rule (null if none fits) and verdict (the rule's, else default).

    A rule (verdict, host, path) fits its host and all subdomains when the url's path starts with the rule's path.
    Null urls and urls without '://' have empty host and path, and the default verdict. Null ids, repeated rows and
    ties stay as they are, one row each; other columns of df are not carried, so none can clash. An empty df gives
    an empty result.
    """
    host, path = url_parts(F.col(url_col))
    parts = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rules = [(v, h.translate(_LOWER), p) for v, h, p in rules]
    if len(rules) > MAX_TRIE_RULES or sum(len(h) + len(p) for _, h, p in rules) > MAX_TRIE_CHARS:
        return _by_join(parts, rules, id_col, default)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [match(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return parts.withColumn("judged", judge("host", "path")).select(id_col, "host", "path", F.col("judged.rule").alias("rule"), F.coalesce("judged.verdict", F.lit(default)).alias("verdict"))


def _by_join(parts: DataFrame, rules: list[tuple[str, str, str]], id_col: str, default: str) -> DataFrame:
    """The same matches by an equi-join on (host suffix, whole leading segments), for rule lists too large to broadcast."""
    spark = parts.sparkSession
    rows = [(h, "".join(_segments(p)[0]), _segments(p)[1], f"{h}{p}", v, len(h) + len(p), len(h)) for v, h, p in rules]
    right = spark.createDataFrame(rows, "r_host string, r_lead string, r_rest string, r_rule string, r_verdict string, r_size int, r_hsize int")
    keyed = parts.withColumn("at", F.monotonically_increasing_id())
    distinct = keyed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    segments = F.split("path", "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lead = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), n), "/"), F.lit("/"))))
    found = (
        distinct.withColumn("r_host", F.explode(suffix)).withColumn("r_lead", F.explode(lead)).join(right, ["r_host", "r_lead"])
        .where(F.substr(F.col("path"), F.length("r_lead") + 1).startswith(F.col("r_rest")))
        .groupBy("host", "path").agg(F.max(F.struct("r_size", "r_hsize", (F.col("r_verdict") == "block").alias("b"), "r_rule", "r_verdict")).alias("best"))
    )
    return parts.join(found, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


