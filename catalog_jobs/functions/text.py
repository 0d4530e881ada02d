"""Parsing of titles, counts, dates, lists and urls, as functions from columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels that listings put beside a title.
VERSION_WORDS = ["V0", "V1", "V2", "V3", "V4", "FINAL", "PROLOGUE", "ALPHA", "BETA", "DEMO", "CH.", "CHAPTER", "UPDATE", "EPISODE", "EP.", "VERSION"]
CATEGORIES = ["README", "SITERIP", "COLLECTION", "VN"]
ENGINES = ["OTHERS", "RAGS", "RPGM", "WEBGL", "UNITY", "HTML", "QSP", "JAVA", "REN'PY", "UNREAL ENGINE", "WOLF RPG", "FLASH", "ADRIFT", "TADS"]
STATUSES = ["COMPLETED", "ONHOLD", "ABANDONED"]


def norm(c: Column) -> Column:
    """Letters and digits of any script, in upper case."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def _no_brackets(c: Column) -> Column:
    return F.translate(c, "[]", "")


def is_version_token(token: Column, match: str = "whole") -> Column:
    """Whether a token is a version word: the whole normalised token, or with match='prefix' a word that begins it (then digits and dots may follow)."""
    if match == "prefix":
        words = "|".join(w.rstrip(".") for w in VERSION_WORDS if not w[-1].isdigit())
        return F.coalesce(F.upper(F.trim(token)).rlike(rf"^(V\.? ?[0-9]|(?:{words})\b|CH[ .]|EP[ .])"), F.lit(False))
    return F.coalesce(norm(token).isin(VERSION_WORDS), F.lit(False))


def split_title(text: Column, version_match: str = "whole") -> Column:
    """struct(title, version, creator) of 'Title [version] [creator]'.

    One bracket holds a version if it is a version word, else a creator; two hold both; any other number neither. What isn't given is
    null. The title keeps its blanks.
    """
    parts = F.split(text, r"\[")
    n = F.size(parts)
    second, third = (F.trim(_no_brackets(F.get(parts, i))) for i in (1, 2))
    version = is_version_token(F.trim(F.get(parts, F.lit(1))), version_match)
    return F.struct(
        _no_brackets(F.get(parts, 0)).alias("title"),
        F.when((n == 3) | ((n == 2) & version), second).alias("version"),
        F.when(n == 3, third).when((n == 2) & ~version, second).alias("creator"),
    )


def short_name(title: Column) -> Column:
    return norm(title)


def entity_key(title: Column, creator: Column, creator_rule: str = "keep_spaces") -> Column:
    """short_name + '_' + creator in upper case; 'drop_spaces' also removes the creator's blanks. A null creator counts as empty."""
    who = F.coalesce(creator, F.lit(""))
    if creator_rule == "drop_spaces":
        who = F.replace(F.trim(who), F.lit(" "), F.lit(""))
    elif creator_rule != "keep_spaces":
        raise ValueError(creator_rule)
    return F.concat(short_name(F.coalesce(title, F.lit(""))), F.lit("_"), F.upper(who))


def thread_id_from_url(url: Column) -> Column:
    """What follows the last dot, letters and digits only."""
    return F.regexp_replace(F.substring_index(url, ".", -1), r"[^\p{L}\p{N}]+", "")


def parse_thread_labels(anchors: Column, version_match: str = "whole", label_brackets: bool = False) -> Column:
    """struct(category, engine, status, title, version, creator, href) of array<struct<text, href>>, the links of one listing row.

    Each link's text is a category, an engine, a status or else a title; where several are of one kind, the last counts. href is the last
    link's. With label_brackets, '[Unity]' counts as 'Unity'.
    """
    def label(a: Column) -> Column:
        text = F.upper(a["text"])
        return F.regexp_replace(text, r"^\[(.*)\]$", "$1") if label_brackets else text

    def last(values: list[str]) -> Column:
        return _no_brackets(F.get(F.reverse(F.filter(anchors, lambda a: label(a).isin(values))), 0)["text"])

    titles = F.transform(F.filter(anchors, lambda a: ~label(a).isin(CATEGORIES + ENGINES + STATUSES)), lambda a: split_title(a["text"], version_match))

    def last_given(name: str) -> Column:
        return F.get(F.reverse(F.filter(titles, lambda t: t[name].isNotNull())), 0)[name]

    return F.struct(
        last(CATEGORIES).alias("category"), last(ENGINES).alias("engine"), last(STATUSES).alias("status"),
        *(last_given(n).alias(n) for n in ("title", "version", "creator")),
        F.get(F.reverse(anchors), 0)["href"].alias("href"),
    )


def compact_count(text: Column) -> Column:
    """'12,345', '12K', '1.5m' -> bigint; null where there is no number."""
    t = F.lower(F.replace(F.trim(text), F.lit(","), F.lit("")))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([km]?)$", 1).try_cast("decimal(20,4)")
    unit = F.regexp_extract(t, r"([km])$", 1)
    factor = F.when(unit == "k", 1000).when(unit == "m", 1000000).otherwise(1)
    return F.floor(number * factor).cast("bigint")


def rating_text(text: Column) -> Column:
    """'4.50 star(s)' -> 4.5; null where absent or not a number."""
    return F.trim(F.replace(text, F.lit("star(s)"), F.lit(""))).try_cast("double")


def to_epoch(text: Column) -> Column:
    """'2023-1-5' or '2023-1-5 3:4:5' -> seconds since 1970 in UTC (set the session's zone to UTC); 0 for all else."""
    exact = F.when(text == F.trim(text), text)
    tried = [F.unix_timestamp(F.try_to_timestamp(exact, F.lit(f))) for f in ("yyyy-M-d H:m:s", "yyyy-M-d")]
    return F.coalesce(*tried, F.lit(0)).cast("bigint")


def iso_to_text(text: Column) -> Column:
    """'2023-01-05T12:00:00+0000' -> '2023-01-05 12:00:00'; empty for null."""
    t = F.coalesce(text, F.lit(""))
    return F.replace(F.substring(t, F.lit(1), F.greatest(F.length(t) - 5, F.lit(0))), F.lit("T"), F.lit(" "))


def rewrite_media_url(url: Column) -> Column:
    return F.replace(url, F.lit("preview"), F.lit("attachments"))


def media_list(urls: Column) -> Column:
    return rewrite_media_url(F.array_join(urls, ","))


def thread_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base), path.cast("string"))


def csv_to_array(c: Column) -> Column:
    """'a,b' -> [a, b]; null or empty -> ['']."""
    return F.split(F.coalesce(c, F.lit("")), ",")


def display_title(title: Column) -> Column:
    return F.replace(title, F.lit("'"), F.lit(""))


def clean_app_name(name: Column) -> Column:
    """Drops each pair of a character that is no letter, digit or _ and white space after it."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]\s", "")


def bool_to_int(c: Column) -> Column:
    return c.cast("int")


def drop_nested_key(maps: Column, key: str) -> Column:
    """map<k, map<string, v>> without `key` in each inner map."""
    return F.transform_values(maps, lambda _, inner: F.map_filter(inner, lambda k, __: k != key))


def page_count(text: Column) -> Column:
    """'1 of 723' -> 723; 0 where it can't be read."""
    return F.coalesce(F.trim(F.get(F.split(F.upper(text), "OF"), 1)).try_cast("int"), F.lit(0))


def overview(first: Column, second: Column) -> Column:
    """The first block's text without its heading, or the second's if that has at most two characters; cut at the first three line ends in a row."""
    def clean(c: Column) -> Column:
        return F.regexp_replace(F.replace(c, F.lit("Overview:"), F.lit("")), r"^\s+|\s+$", "")

    chosen = F.when(F.length(clean(first)) > 2, clean(first)).otherwise(clean(second))
    return F.coalesce(F.get(F.split(chosen, "\n\n\n", 2), 0), F.lit(""))


def attachment_links(hrefs: Column) -> Column:
    return F.array_join(F.filter(hrefs, lambda h: F.contains(h, F.lit("attachments"))), ",")


def tag_list(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), ",")


def banner(src: Column) -> Column:
    return F.replace(src, F.lit("/thumb/"), F.lit("/"))


def null_if_blank(c: Column, epoch: bool = False) -> Column:
    """Null for '' (and for 0 in an epoch column), so that the value doesn't overwrite a stored one."""
    return F.nullif(c, F.lit(0)) if epoch else F.nullif(c, F.lit(""))
