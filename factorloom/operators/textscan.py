"""Pattern, structure and link checks over text and page tables.

Every check of a row looks at the whole text and needs no shuffle; only link targets are
compared across pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns for secrets and for network or credential use.
SECRET_PATTERNS = (
    ("assignment_secret", r"""(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd)\b\s*[:=]\s*['"]?([^'"\s<]{8,})"""),
    ("cloud_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
NETWORK_PATTERNS = (
    ("wrds_connection", r"(?i)\bwrds\s*\.\s*Connection\s*\("),
    ("wrds_credentials", r"(?i)\bwrds\b.*\b(?:user|username|pass|password|credential|login|prompt)\b"),
    ("credential_prompt",
     r"(?i)\b(?:getpass\s*\(|input\s*\().{0,80}\b(?:wrds|user|username|pass|password|credential|login)\b"),
    ("requests_download", r"(?i)\brequests\s*\.\s*(?:get|post|put|request)\s*\("),
    ("urllib_download", r"(?i)\burllib\.request\s*\.\s*(?:urlopen|urlretrieve)\s*\("),
    ("subprocess_network_download", r"(?i)\b(?:curl|wget)\b"),
    ("fred_api_download", r"(?i)\b(?:fredapi|pandas_datareader)\b"),
)
# Lower-case words, one of which every match of a pattern contains.
NEEDED_WORDS = {
    "assignment_secret": ("key", "secret", "token", "passw", "pwd"),
    "cloud_key": ("akia", "asia"),
    "private_key": ("private key",),
    "wrds_connection": ("wrds",),
    "wrds_credentials": ("wrds",),
    "credential_prompt": ("getpass", "input"),
    "requests_download": ("requests",),
    "urllib_download": ("urllib",),
    "subprocess_network_download": ("curl", "wget"),
    "fred_api_download": ("fredapi", "pandas_datareader"),
}
LINE_BREAK = r"\r\n|\n|\r"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pattern_findings(
    texts: DataFrame, patterns: Sequence[tuple[str, str]] = SECRET_PATTERNS, *, id_column: str = "doc_id",
    text_column: str = "text", skip_comments: bool = False,
) -> DataFrame:
    """(id, line number, pattern, line) for every line that matches a pattern.

    With ``skip_comments`` blank lines and lines that begin with # are passed over.  Texts and
    lines without any word that a pattern needs are set aside by plain substring search before
    the expressions run.
    """
    def may_match(text: Column, names: Sequence[str]) -> Column:
        if any(n not in NEEDED_WORDS for n in names):
            return F.lit(True)
        words = dict.fromkeys(w for n in names for w in NEEDED_WORDS[n])
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])

    candidates = texts.where(may_match(F.lower(F.col(text_column)), [n for n, _ in patterns]))
    lines = candidates.select(id_column, F.posexplode(F.split(F.col(text_column), LINE_BREAK)).alias("n", "line"))
    if skip_comments:
        stripped = _stripped(F.col("line"))
        lines = lines.where((stripped != "") & ~stripped.startswith("#"))
    lines = lines.withColumn("lower", F.lower("line"))
    hits = F.array_compact(F.array(*[
        F.when(may_match(F.col("lower"), [name]) & F.col("line").rlike(p), F.lit(name)) for name, p in patterns
    ]))
    return lines.select(
        id_column, (F.col("n") + 1).alias("line"), F.explode(hits).alias("pattern"), _stripped(F.col("line")).alias("text")
    )


def _markup(html: Column) -> Column:
    """The page without comments, scripts and styles, whose content holds no tags."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def page_structure(pages: DataFrame) -> DataFrame:
    """Which of the html, title and body tags each page has."""
    html = F.col("markup")
    flags = {f"has_{t}": html.rlike(rf"(?i)<{t}[\s/>]") for t in ("html", "title", "body")}
    checked = pages.withColumn("markup", _markup(F.col("html"))).withColumns(flags).drop("markup")
    return checked.withColumn("ok", F.col("has_html") & F.col("has_title") & F.col("has_body"))


_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""


# Character references by name that are resolved in links, beside all numeric ones.
NAMED_REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def resolved_references(text: Column) -> Column:
    """Character references replaced by their characters, in one pass: ``&amp;lt;`` gives ``&lt;``.

    References that are not known, or name no character, stay as they are.
    """
    parts = F.split(text, "&", -1)
    by_name = F.create_map(*[F.lit(x) for pair in NAMED_REFERENCES.items() for x in pair])

    def resolve(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+);", 1)
        rest = F.substr(part, F.length(name) + 2)
        base = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        code = F.when(name.startswith("#"), base).try_cast("int")
        can = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(F.when(can, code)), 8, "0")), "UTF-32")
        value = F.when(name.startswith("#"), letter).otherwise(F.try_element_at(by_name, name))
        return F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), part))

    later = F.transform(F.slice(parts, F.lit(2), F.size(parts)), resolve)
    return F.when(~text.contains("&"), text).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(later, "")))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, href) for every link of the page, in the page's order; character references are resolved."""
    raw = F.regexp_extract_all(_markup(F.col("html")), F.lit(_ANCHOR), F.lit(1))
    links = pages.select("page_id", "url", F.posexplode(raw).alias("n", "raw"))
    return links.select("page_id", "url", "n", resolved_references(F.regexp_replace("raw", r"""^["']|["']$""", "")).alias("href")).where(
        F.col("href") != ""
    )


def _site(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def _walk(path: Column) -> Column:
    """Path parts after . and .. are resolved; NULL if they leave the site's root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(state, part):
        up = (part == "..") & (F.size(state["parts"]) == 0)
        parts = (
            F.when(part.isin("", "."), state["parts"])
            .when(part == "..", F.slice(state["parts"], F.lit(1), F.greatest(F.size(state["parts"]) - 1, F.lit(0))))
            .otherwise(F.concat(state["parts"], F.array(part)))
        )
        return F.struct(parts.alias("parts"), (state["out"] | up).alias("out"))

    return F.aggregate(
        F.split(path, "/"), start, step,
        lambda s: F.when(~s["out"], F.concat(F.lit("/"), F.array_join(s["parts"], "/"))),
    )


def link_errors(pages: DataFrame) -> DataFrame:
    """Local links that leave the site, whose page is missing, or whose fragment is missing.

    Links with a scheme or host, and links to a fragment of the same page, are not checked.
    Links to one target collapse before targets are looked up, so a target that a third of
    all links point to is looked up once.
    """
    links = page_links(pages).where(~F.col("href").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"))
    target = F.regexp_replace("href", r"#.*$", "")
    fragment = F.regexp_extract("href", r"#(.*)$", 1)
    base = F.regexp_replace(_path(F.col("url")), r"[^/]*$", "")
    full = F.when(target.startswith("/"), target).otherwise(F.concat(base, target))
    local = links.where(target != "").select(
        "page_id", "n", "href", _site(F.col("url")).alias("site"), _walk(full).alias("path"), fragment.alias("fragment")
    )
    known = pages.select(_site(F.col("url")).alias("site"), _walk(_path(F.col("url"))).alias("path"), "html")
    wanted = local.where(F.col("path").isNotNull()).select("site", "path").distinct()
    found = wanted.join(known.select("site", "path").distinct(), ["site", "path"], "left_semi")
    marks = known.select(
        "site", "path", F.explode(F.regexp_extract_all("html", F.lit(r"""id=["']([^"']*)["']"""), F.lit(1))).alias("raw")
    ).select("site", "path", resolved_references(F.col("raw")).alias("fragment")).distinct()
    checked = local.join(found.withColumn("exists", F.lit(True)), ["site", "path"], "left").join(
        marks.withColumn("marked", F.lit(True)), ["site", "path", "fragment"], "left"
    )
    problem = (
        F.when(F.col("path").isNull(), "escapes site").when(F.col("exists").isNull(), "broken link")
        .when((F.col("fragment") != "") & F.col("marked").isNull(), "missing fragment")
    )
    return checked.select("page_id", "n", "href", problem.alias("problem")).where(F.col("problem").isNotNull())
