"""What pages hold: their text, links and images, and which addresses robots rules allow. A null page is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomset.functions import urls

# Elements without content of their own, and those that end a line.
BOILERPLATE = ["script", "style", "nav", "footer", "header", "aside", "form"]
BLOCKS = r"(?i)</?(?:p|div|br|li|tr|h[1-6]|article|section|ul|ol|table|title|body)\b[^>]*>"
ATTRIBUTE = r"""[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+"""
BETWEEN = r"""(?:[\s/]++|(?<=["']))"""
#: An anchor up to its first href; its value is in quotes of either kind or none. Possessive, so that no page takes long.
ANCHOR = rf"""(?i)<a(?:{BETWEEN}(?!href[\s=]){ATTRIBUTE})*+{BETWEEN}href\s*=\s*("[^"]*+"|'[^']*+'|[^\s>"']++)"""
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def page_text(html: Column) -> Column:
    """Lines of text outside boilerplate elements, trimmed, blank ones left out."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in BOILERPLATE:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    t = F.regexp_replace(F.regexp_replace(t, BLOCKS, "\n"), r"<[^>]*>", "")
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Each distinct link of a page as a whole address; those that begin with # (within the page) and scripts are left out."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(1)))
    x = pages.select(key, F.col(url).alias("__base"), F.explode(found).alias("link"))
    x = x.withColumn("link", F.trim(F.regexp_replace("link", r"""^["']|["']$""", ""))).filter("link <> '' and link not like '#%' and lower(link) not like 'javascript:%'")
    for name, char in ENTITIES.items():
        x = x.withColumn("link", F.replace("link", F.lit(name), F.lit(char)))
    return x.select(key, urls.resolved(F.col("link"), F.col("__base")).alias("link")).distinct()


def robots_rules(files: DataFrame, host: str, text: str) -> DataFrame:
    """host, agent, place, allow and prefix of every rule of robots files; an agent's lines hold until the next agent."""
    lines = files.select(host, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("place", "line"))
    part = lines.select(host, "place", F.lower(F.trim(F.regexp_extract("line", r"^([^:#]+):", 1))).alias("field"), F.trim(F.regexp_extract("line", r"^[^:#]+:([^#]*)", 1)).alias("value"))
    w = Window.partitionBy(host).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(w)
    rules = part.withColumn("agent", agent).filter("field in ('allow', 'disallow') and value <> '' and agent is not null")
    return rules.select(host, "agent", "place", (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix"))


def fetchable(pages: DataFrame, key: str, url: str, rules: DataFrame, host: str, agent: str) -> DataFrame:
    """Whether an agent may fetch each address: the first rule in the file whose prefix its path has; yes if none has.

    Rules are the agent's own, or those for `*` where a host has none.
    """
    own = rules.groupBy(host).agg(F.max(F.col("agent") == agent.lower()).alias("named"))
    mine = rules.join(own, host).filter(F.col("agent") == F.when(F.col("named"), agent.lower()).otherwise("*")).select(F.col(host).alias("__host"), "place", "allow", "prefix")
    x = pages.select(key, urls.host(F.col(url)).alias("__host"), urls.path(F.col(url)).alias("__path"))
    met = x.join(mine, "__host").filter(F.col("__path").startswith(F.col("prefix"))).groupBy(key).agg(F.min_by("allow", "place").alias("allowed"))
    return x.select(key).join(met, key, "left").select(key, F.coalesce("allowed", F.lit(True)).alias("allowed"))
