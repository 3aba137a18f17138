"""URL filter: per-host path-template trees, pruned by smoothed labelled purity, under explicit rules.

1. Urls are counted by host and path shape. In a shape, segments that carry numbers or codes are already one
   class each, so the table of shapes is far smaller than that of urls.
2. Level by level, each node of a host's tree compares every child with its siblings together. A child whose
   share of bad labels and whose share of urls that end there do not differ significantly from its siblings' is
   merged with them into the wildcard ``*``; so is a child with too little evidence below a node of many
   children. Children that differ stay branches of their own.
3. A template is rejected if its share of bad labels, smoothed towards its host's and that towards the overall
   share, exceeds a threshold.

An explicit rule that fits a url's host (or a parent domain) and the start of its path decides before the
template does; of several, the longest.

Labels, if none are given, are weak ones from the text of each page; the words of a url are never looked at, so a url
is blocked only by its template.

Defined results: null urls and urls without ``://`` have empty host and path; very long urls are read whole, to their
deepest segment; repeated rows count as often as they occur; rows whose label is null count as unlabelled, as do pages
of few words, null or empty; a difference or share that equals its bound does not exceed it, so the child merges and
the template is allowed; an empty table gives no rows; further columns, of whatever names, are kept out of the result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import few, materialize

#: A node with more children than this is variable; |z| from which two shares differ; labels that are evidence.
MANY, DIFFERS, EVIDENCE = 16, 2.6, 5
#: Pseudo-labels of the smoothing, and the share of bad labels that rejects a template.
SMOOTHING, REJECT = 2.0, 0.5
#: Characters of the shapes below one template prefix up to which one task settles them.
GROUP_CHARS = 8 << 20
#: A page is labelled from so many words on; it is bad from these signs, or suspect words, per word on.
LEAST_WORDS, SIGNS, SUSPECTS = 20, 0.1, 0.02
#: Words that mark a page's text as bad, as weak labels.
SUSPECT = "ad ads adserver advert banner tracker track tracking spam adult porn sex casino gambling bet poker viagra pills phishing malware warez torrent".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; rules are (verdict, host/path). Meant for up to some hundred rules."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found, verdict = F.when(fits, text).otherwise(found), F.when(fits, what).otherwise(verdict)
    return found, verdict


def weak_label(html: Column) -> Column:
    """1 if the page's text has many signs or suspect words, 0 if not, null if it has few words. Its url plays no part."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731 - computes the value once
    outside = F.filter(F.split(html, r"(?i)</?(?:script|style)\b[^<>]*+>"), lambda x, i: i % 2 == 0)
    text = F.lower(F.regexp_replace(F.array_join(outside, " "), r"<[^<>]*+>|&[a-z]+;|&#[0-9]+;", " "))

    def judged(text: Column) -> Column:
        signs = F.regexp_count(text, F.lit("[#*$%|^~]"))
        suspects = F.regexp_count(text, F.lit(rf"(?<![a-z])(?:{'|'.join(SUSPECT)})(?![a-z])"))
        many = lambda words: F.when(words >= LEAST_WORDS, ((signs > SIGNS * words) | (suspects > SUSPECTS * words)).cast("int"))
        return let(F.regexp_count(text, F.lit(r"\S++")), many)

    return let(text, judged)


def shape(path: Column) -> Column:
    """The path's segments, numbers and codes generalised."""
    tidy = F.regexp_replace(path, "[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|[0-9a-fA-F]{16,}|[0-9]+", "#")
    return F.filter(F.split(tidy, "/"), lambda s: s != "")


def _z(x: str, n: str, all_x: str, all_n: str) -> Column:
    """How far a child's share x / n lies from that of its siblings, in standard errors of a smoothed difference."""
    p, q = ((F.col(a) + 0.5) / (F.col(b) + 1) for a, b in ((x, n), (all_x, all_n)))
    pooled = (F.col(x) + F.col(all_x) + 1) / (F.col(n) + F.col(all_n) + 2)
    return F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / (F.col(n) + 1) + 1 / (F.col(all_n) + 1)))


def _generalise(tree: DataFrame, level: int) -> DataFrame:
    """Replaces the segment at one level of every template by ``*`` where it merges."""
    here = tree.where(F.size("template") > level)
    node = here.select("*", F.array_join(F.slice("template", 1, level), "/").alias("above"), F.col("template")[level].alias("segment"), F.when(F.size("template") == level + 1, F.col("n")).otherwise(0).alias("ends"))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad", "ends")]
    child = node.groupBy("host", "above", "segment").agg(*sums)
    parent = child.groupBy("host", "above").agg(F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad", "ends")])
    both = child.join(parent, ["host", "above"]).where("children > 1")
    for c in ("n", "labelled", "bad", "ends"):
        both = both.withColumn(f"all_{c}", F.col(f"all_{c}") - F.col(c))
    proven = (F.col("labelled") >= EVIDENCE) & (F.col("all_labelled") >= EVIDENCE)
    alike = (~proven | (_z("bad", "labelled", "all_bad", "all_labelled") < DIFFERS)) & (_z("ends", "n", "all_ends", "all_n") < DIFFERS)
    thin = (F.col("children") > MANY) & (F.col("labelled") < EVIDENCE)
    merged = both.where(alike | thin).select("host", "above", "segment", F.lit(True).alias("merged"))
    start, end = F.slice("template", 1, level), F.expr(f"slice(template, {level + 2}, size(template))")
    key = [F.array_join(start, "/").alias("above"), F.when(F.size("template") > level, F.col("template")[level]).alias("segment")]
    put = tree.select("*", *key).join(merged, ["host", "above", "segment"], "left")
    template = F.when(F.col("merged"), F.concat(start, F.array(F.lit("*")), end)).otherwise(F.col("template"))
    return put.select("host", "shape", template.alias("template"), "n", "labelled", "bad")


def _differs(x: int, n: int, all_x: int, all_n: int) -> float:
    """``_z`` of numbers."""
    p, q = (x + 0.5) / (n + 1), (all_x + 0.5) / (all_n + 1)
    pooled = (x + all_x + 1) / (n + all_n + 2)
    return abs(p - q) / math.sqrt(pooled * (1 - pooled) * (1 / (n + 1) + 1 / (all_n + 1)))


def _settle(shapes: list[list[str]], counts: list[tuple[int, int, int]], level: int) -> None:
    """``_generalise`` of shapes that are equal up to a level, at all deeper levels, in place. counts: n, labelled, bad."""
    todo = [(list(range(len(shapes))), level)]
    while todo:
        rows, level = todo.pop()
        children: dict[str, list[int]] = {}
        for i in rows:
            if len(shapes[i]) > level:
                children.setdefault(shapes[i][level], []).append(i)
        if len(children) > 1:
            sums = {}
            for segment, own in children.items():
                n, labelled, bad = (sum(counts[i][c] for i in own) for c in range(3))
                sums[segment] = n, labelled, bad, sum(counts[i][0] for i in own if len(shapes[i]) == level + 1)
            total = [sum(x) for x in zip(*sums.values(), strict=True)]
            below: dict[str, list[int]] = {}
            for segment, (n, labelled, bad, ends) in sums.items():
                others = [t - x for t, x in zip(total, (n, labelled, bad, ends), strict=True)]
                proven = labelled >= EVIDENCE and others[1] >= EVIDENCE
                alike = (not proven or _differs(bad, labelled, others[2], others[1]) < DIFFERS) and _differs(ends, n, others[3], others[0]) < DIFFERS
                name = "*" if alike or len(children) > MANY and labelled < EVIDENCE else segment
                below.setdefault(name, []).extend(children[segment])
                for i in children[segment]:
                    shapes[i][level] = name
            children = below
        todo += [(own, level + 1) for own in children.values() if len(own) > 1]


def _settled(tree: DataFrame, level: int) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shapes = [list(t) for t in group["template"]]
        _settle(shapes, list(zip(group["n"].tolist(), group["labelled"].tolist(), group["bad"].tolist(), strict=True)), level)
        return group[["host", "shape"]].assign(template=shapes, n=group["n"], labelled=group["labelled"], bad=group["bad"])

    return tree.groupBy("host", "stem").applyInPandas(run, "host string, shape array<string>, template array<string>, n long, labelled long, bad long")


def templates(urls: DataFrame) -> DataFrame:
    """From rows (host, shape, bad): host, shape, template and purity (smoothed share of bad labels)."""
    label = F.col("bad").cast("long")
    tree = materialize(urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("bad")).withColumn("template", F.col("shape")).select("host", "shape", "template", "n", "labelled", "bad"))
    labelled, bad = tree.agg(F.sum("labelled"), F.sum("bad")).first()
    done, level = [], 0
    while True:
        done.append(tree.where(F.size("template") <= level))
        rest = tree.where(F.size("template") > level).withColumn("stem", F.array_join(F.slice("template", 1, level), "/"))
        chars = F.sum(F.length(F.array_join("template", "/")) + 1)
        large = few(rest.groupBy("host", "stem").agg(chars.alias("chars")).where(F.col("chars") > GROUP_CHARS).select("host", "stem"))
        if not large.known_rows:
            done.append(_settled(rest, level))
            break
        done.append(materialize(_settled(rest.join(large, ["host", "stem"], "left_anti"), level)))
        tree = materialize(_generalise(rest.join(large, ["host", "stem"], "left_semi").drop("stem"), level))
        level += 1
    tree = done[0]
    for part in done[1:]:
        tree = tree.unionByName(part)
    tree = materialize(tree)
    overall = (bad or 0) / max(1, labelled or 0)
    ratio = lambda prior: (F.sum("bad") + SMOOTHING * prior) / (F.sum("labelled") + SMOOTHING)
    host = tree.groupBy("host").agg(ratio(F.lit(overall)).alias("host_share"))
    own = tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
    purity = own.join(host, "host").select("host", "template", ((F.col("b") + SMOOTHING * F.col("host_share")) / (F.col("l") + SMOOTHING)).alias("purity"))
    return tree.select("host", "shape", "template").join(purity, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str]], label: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity per row. label: 1 bad, 0 good, null unknown; weak labels
    from the pages' html if left out."""
    host, path = host_and_path(F.col("url"))
    bad = label if label is not None else weak_label(F.col("html").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), shape(path).alias("shape"), bad.cast("int").alias("bad"))
    found, verdict = rule(F.col("host"), F.col("path"), rules)
    named = templates(rows).select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
    out = rows.drop("bad").join(named, ["host", "shape"], "left")
    own = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", found.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
