"""Allow and block rules for URLs, carried over to aliases along redirects and canonical links."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, keyed_join, lean, prepare, text_column, written


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def own_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, own) for the distinct (host, path) of urls that a rule (verdict, host, path) fits.

    A rule fits its host and the host's subdomains, if the path starts with its own. The longest rule wins,
    of equally long ones an allowing one, then the first by its text. A URL meets the rules by equality: each
    suffix of its host at a dot, with each prefix of its path that is as long as some rule's.
    """
    rules = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).where("host is not null and path is not null").distinct()
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"))
    pairs = urls.select("host", "path").where("host <> ''").distinct().crossJoin(F.broadcast(lengths))
    labels = F.split("host", r"\.")
    pairs = pairs.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    pairs = pairs.withColumn("cut", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("rule_path", F.expr("left(path, cut)"))
    fits = keyed_join(pairs, rules, ["rule_host", "rule_path"], "inner")
    text = F.concat("rule_host", "rule_path")
    best = F.min_by(F.struct(text.alias("rule"), F.col("verdict").alias("own")), F.struct(-F.length(text), "verdict", text))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.own")


def url_key(url: Column) -> Column:
    """One spelling of equal URLs: scheme and host in lower case, no default port, no fragment, a path of / at least."""
    root = F.translate(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    root = F.regexp_replace(F.regexp_replace(root, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(root, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(url)


_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)")
_TAG = re.compile(r"""(?is)<([a-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>""")
_ATTRIBUTE = re.compile(r"""(?s)([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_REFRESH = re.compile(r"""(?is)\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(?:"([^"]*)|'([^']*)|(.*))""")


def alias_targets(url: str, page: str) -> list[str]:
    """Where the canonical links and refresh tags of a page lead, whole URLs in order, without repeats."""
    base, found = url, []
    tags = [(m[1].lower(), {a[1].lower(): html.unescape(next((v for v in a.groups()[1:] if v is not None), "")).strip() for a in _ATTRIBUTE.finditer(m[2])}) for m in _TAG.finditer(_HIDDEN.sub(" ", page))]
    for to in [t["href"] for name, t in tags if name == "base" and "href" in t][:1]:
        base = _joined(url, to) or url
    for name, t in tags:
        to = None
        if name == "link" and "canonical" in t.get("rel", "").lower().split():
            to = t.get("href")
        elif name == "meta" and t.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(t.get("content", ""))):
            to = next(v for v in m.groups() if v is not None).strip()
        if to and (whole := _joined(base, to)) and whole not in found:
            found.append(whole)
    return found


def _joined(base: str, to: str) -> str | None:
    try:
        whole = urljoin(base, to)
    except ValueError:  # no URL
        return None
    return whole if "://" in whole else None


@lean
def _targets(batches):
    for batch in batches:
        src, dst = [], []
        for url, page in zip(batch["src"].to_pylist(), text_column(batch, "html").to_pylist()):
            found = alias_targets(url, page)
            src += [url] * len(found)
            dst += found
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], names=["src", "dst"])


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) URLs that are one: a page's canonical links, the redirects of its refresh tags, and its own url_key.

    Every such tag counts, its attributes in any order, with entities decoded, outside comments, scripts and styles.
    References are resolved against the page's URL or its base tag; dst is a url_key. Targets that aren't URLs with
    :// are left out, and so are pages without such a URL. Null and long pages are read like all others; links of a
    page to itself are none; repeated rows repeat their links; an empty table gives none; other columns are not read.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(url_col).alias("src"), F.col(html_col).alias("html")).where(F.col("src").contains("://"))
    low = F.lower("html")
    tags = rows.where(low.contains("canonical") | low.contains("refresh")).mapInArrow(_targets, "src string, dst string")
    return tags.union(rows.select("src", F.col("src").alias("dst"))).select("src", url_key(F.col("dst")).alias("dst")).where("src <> dst")


def url_verdicts(pages: DataFrame, rules: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, component) for every row of pages.

    A URL's own rule decides. Without one, its aliases do: the URLs reachable over links (src, dst) taken in
    both directions. If a rule allows any of them, the URL is allowed; else, if one is blocked, it is blocked;
    else it is allowed. component is the smallest URL of the class.
    Null URLs and URLs without :// have an empty host and path, no rule and the verdict allow. Null ids and
    repeated rows keep their rows; rules with a null part are none; links with a null end are ignored. Of rules that
    tie in length an allowing one wins. An empty table of pages gives an empty result, empty rules or links
    decide nothing. Columns of pages other than the two are not read; page texts are not needed here.
    """
    prepare(pages.sparkSession)
    links = written(links.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "url-links")
    split = lambda df: df.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    rows = split(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    comp = written(connected_components(links, "url-components"), "url-classes").withColumnRenamed("node", "url")
    nodes = split(comp)
    decided = written(own_rules(rows.select("host", "path").unionByName(nodes.select("host", "path")), rules), "url-rules")
    classes = nodes.join(decided, ["host", "path"], "left").groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
    alias = comp.join(classes, "component").select("url", "component", "allowed", "blocked")
    out = rows.join(decided, ["host", "path"], "left").join(alias, "url", "left")
    verdict = F.coalesce("own", F.when(F.coalesce("allowed", F.lit(0)) == 1, "allow").when(F.coalesce("blocked", F.lit(0)) == 1, "block").otherwise("allow"))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "url").alias("component"))
