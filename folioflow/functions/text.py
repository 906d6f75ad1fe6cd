"""Column functions on text; no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
#: Headings that running headers are often taken for.
RUNNING_HEADERS = ("perspective", "review", "article", "analysis", "commentary", "brief communication", "letter", "述评", "综述", "文章", "评论", "快讯")
#: Chinese ordinals 0 to 30.
CN_ORDINALS = ("零", *"一二三四五六七八九", "十", *("十" + c for c in "一二三四五六七八九"), "二十", *("二十" + c for c in "一二三四五六七八九"), "三十")
TERMINAL = r"[.!?。！？…:：;；]"


#: How headings are numbered.
_ARABIC, _CHINESE = r"\d+(?:\.\d+)*[.、)]?", "[一二三四五六七八九十]+"
#: The notations that a translation must keep as they are, each with the group that counts.
PROTECTED = {
    "math": (r"(?<!\\)\$\$[\s\S]*?(?<!\\)\$\$|\\\([\s\S]*?\\\)|\\\[[\s\S]*?\\\]|(?<![\\$])\$(?!\$)[^\n$]*?(?<!\\)\$", 0),
    "destinations": (r"!?\[[^\]\n]*\]\(([^)\n]+)\)", 1), "html_paths": (r"(?i)\b(?:src|href)\s*=\s*[\"']([^\"']+)[\"']", 1), "footnotes": (r"\[\^[^\]]+\]", 0),
    "code": (r"```[\s\S]*?```|`[^`\n]+`", 0), "mathml": (r"(?i)<math\b[\s\S]*?</math>", 0),
}


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def contains_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def normalized(c: Column) -> Column:
    """Letters, digits and underscores only, without tags, entities resolved, lower case."""
    t = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_]", ""))


def looks_like_continuation(c: Column) -> Column:
    """Begins, after blanks, in lower case or with a digit."""
    return c.rlike(r"^\s*[\p{Ll}\p{Nd}]")


def ends_sentence(c: Column) -> Column:
    return strip(c).rlike(TERMINAL + "[\"'”’)）\\]]*$")


def heading_text(c: Column) -> Column:
    """A heading without its number (arabic, Chinese, in brackets) and final period."""
    number = "|".join((f"{_ARABIC}\\s+", f"{_CHINESE}、\\s*", f"[(（](?:\\d+|{_CHINESE})[)）]\\s*"))
    bare = F.regexp_replace(strip(c), f"^(?:{number})", "")
    return F.when(bare.endswith(".") | bare.endswith("。"), F.left(bare, F.length(bare) - 1)).otherwise(bare)


def is_running_header_word(c: Column) -> Column:
    t = F.regexp_replace(c, r"^[一二三四五六七八九十\d.\s、]+", "")
    return F.lower(strip(t)).isin(*RUNNING_HEADERS)


def cn_ordinal(n: Column) -> Column:
    """0 to 30 in Chinese, other numbers in digits."""
    return F.when(n.between(0, 30), F.element_at(F.array(*map(F.lit, CN_ORDINALS)), (n + 1).cast("int"))).otherwise(n.cast("string"))


def slug(c: Column) -> Column:
    """A heading's anchor: lower case, words joined by hyphens; empty becomes ``section``."""
    t = F.regexp_replace(F.lower(strip(F.regexp_replace(c, r"<[^>]*>", ""))), r"[^\p{L}\p{N}_\s-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s_-]+", "-"), r"^-+|-+$", "")
    return F.when(t == "", "section").otherwise(t)


def natural_key(c: Column) -> Column:
    """Sorts digits by their value: every run of digits padded to 20."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


def file_stem(title: Column, heading: Column, source: Column) -> Column:
    """A name for an output: the title, else the first heading, else the source's name, without
    addresses, DOIs and signs that file systems forbid, at most 50 characters."""
    t = F.coalesce(F.nullif(strip(title), F.lit("")), F.nullif(strip(heading), F.lit("")), source)
    t = F.regexp_replace(t, r"https?://\S+|(?i:doi:\s*)?10\.\d{4,9}/\S+", "")
    t = F.regexp_replace(F.regexp_replace(t, r'[\\/:*?"<>|]', ""), r"\s+", " ")
    return F.trim(F.substring(F.trim(t), 1, 50))


def caption_parts(c: Column) -> Column:
    """struct(label, title, description) of a caption such as ``Figure 3. Title. More``."""
    label = F.regexp_extract(c, r"^((?i:fig(?:ure)?|table|图|表)\.?\s*\d+)\s*[.:：。]?\s*", 1)
    rest = F.regexp_replace(c, r"^(?i:fig(?:ure)?|table|图|表)\.?\s*\d+\s*[.:：。]?\s*", "")
    title = F.regexp_extract(rest, r"^([^.。]*[.。]?)", 1)
    return F.struct(label.alias("label"), F.trim(title).alias("title"), F.trim(F.regexp_replace(rest, r"^[^.。]*[.。]?", "")).alias("description"))


def is_safe_path(c: Column) -> Column:
    """Relative, of no scheme, and not leading out of its folder."""
    return (F.trim(c) != "") & ~c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^[/\\]|(^|[/\\])\.\.([/\\]|$)|\x00")


def number_between(c: Column, low: float, high: float) -> Column:
    """The number if it is one and in range, else null."""
    n = c.try_cast("double")
    return F.when(n.between(low, high), n)


def join_lines(lines: Column) -> Column:
    """Lines as one text: a hyphen before a letter at a line's end is dropped, and between Han
    or kana there is no blank. Empty and null lines are passed over."""
    wide = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{3000}-\x{30FF}]"
    parts = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")
    return F.aggregate(
        parts, F.lit(""),
        lambda acc, x: F.when(acc == "", x).when(acc.rlike(r"\p{L}-$") & x.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(acc, "-$", ""), x))
        .when(acc.rlike(wide + "$") & x.rlike("^" + wide), F.concat(acc, x)).otherwise(F.concat(acc, F.lit(" "), x)),
    )


def key_values(c: Column) -> Column:
    """A map of ``key=value`` lines; the later of equal keys holds, # begins a comment."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), strip), lambda x: x.contains("=") & ~x.startswith("#"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substr(x, F.locate("=", x) + 1)).alias("value")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))
    return last


def protected_objects(c: Column) -> Column:
    """What a translation must keep as it is, as lists in their order."""
    return F.struct(*(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)).alias(name) for name, (pattern, group) in PROTECTED.items()))
