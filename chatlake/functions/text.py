"""Column expressions over message, query and answer texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists.
INTENTS = {
    "who": ["who", "whose", "author", "contributor", "mentioned", "said"],
    "code": ["function", "class", "method", "sql", "query", "code", "implementation", "snippet", "script"],
    "timeline": ["when", "timeline", "history", "happened", "sequence", "chronology"],
    "comparison": ["compare", "comparison", "versus", "vs", "difference", "better"],
    "summary": ["summary", "summarize", "overview", "recap", "digest"],
    "howto": ["how to", "how do", "how can", "guide", "tutorial", "steps"],
}
CODE_PARTS = ["code", "function", "method", "class", "implementation", "snippet", "script", "query", "sql", "api call", "example"]
ABBREVIATIONS = {
    "db": "database", "k8s": "kubernetes", "api": "application programming interface", "ui": "user interface", "ux": "user experience",
    "ml": "machine learning", "ai": "artificial intelligence", "ci": "continuous integration", "cd": "continuous deployment",
}
QUESTION_WORDS = ["what", "who", "when", "where", "why", "how", "which"]
REMOVED_WORDS = ["what", "who", "when", "where", "why", "how", "which", "is", "are", "was", "were", "did", "does", "do", "can", "could", "would", "should"]
PHRASE_DAYS = {"today": 0, "yesterday": 1, "this week": 7, "last week": 14, "this month": 30, "last month": 60, "this year": 365}

# Patterns.
CHANNEL_PATTERNS = [r"#([a-z0-9_-]+)", r"in\s+(?:the\s+)?([a-z0-9_-]+)\s+channel", r"channel[:\s]+([a-z0-9_-]+)"]
USER_PATTERN, BY_PATTERN = r"@([A-Za-z0-9_.-]+)", r"by\s+([a-z0-9_.-]+)"
APART, ENDS = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
WORD = r"[\p{L}\p{N}_]+"
URL_IN_MESSAGE = r'https?://[^\s<>"{}|\\^`\[\]]+'


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words_pattern(words: list[str]) -> str:
    """Whole words, with every letter of any script counting as part of a word."""
    return r"(?<![\p{L}\p{N}_])(" + "|".join(words) + r")(?![\p{L}\p{N}_])"


def code_languages(text: Column) -> Column:
    return F.transform(all_of(text, r"(?s)```(\w+)?\n(.*?)```", 1), lambda x: F.when(x == "", "unknown").otherwise(x))


def code_bodies(text: Column) -> Column:
    return all_of(text, r"(?s)```(\w+)?\n(.*?)```", 2)


def links(text: Column) -> Column:
    return F.array_sort(F.array_union(all_of(text, r"<(https?://[^|>]+)", 1), all_of(text, URL_IN_MESSAGE)))


def mentions(text: Column) -> Column:
    return all_of(text, r"<@([A-Z0-9]+)>", 1)


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<#[A-Z0-9]+\|([^>]+)>", "#$1"), r"\s+", " "))


def importance(text: Column, reactions: Column, replies: Column, has_file: Column) -> Column:
    total = 1.0 + F.least(reactions * 0.5, F.lit(5.0)) + F.least(replies * 0.3, F.lit(3.0))
    total += F.when(has_file, 2.0).otherwise(0.0) + F.when(text.rlike(URL_IN_MESSAGE), 1.0).otherwise(0.0)
    total += F.when(text.contains("```"), 1.5).otherwise(0.0) + F.when(F.length(text) > 500, 1.0).otherwise(0.0)
    return F.round(total, 2)


def intents(text: Column) -> Column:
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(low.rlike(words_pattern(w)), F.lit(k)) for k, w in INTENTS.items())))
    return F.when(F.size(found) == 0, F.array(F.lit("factual"))).otherwise(found)


def normalized(text: Column) -> Column:
    out = F.lower(text)
    for short, long in ABBREVIATIONS.items():
        out = F.regexp_replace(out, words_pattern([short]), long)
    return out


def entities(text: Column) -> Column:
    """Structs (text, type) in the order quoted, technical, ticket, url; duplicates stay."""
    kind = lambda a, t: F.transform(a, lambda x: F.struct(x.alias("text"), F.lit(t).alias("type")))
    # the capital first, then what stands before it, as most places have no capital
    apart = f"[A-Z]{APART[:-1]}[A-Z])"
    words = all_of(text, apart + "[A-Za-z0-9]++" + ENDS)
    return F.concat(
        kind(all_of(text, '"([^"]+)"', 1), "quoted"),
        kind(words, "technical"),
        kind(all_of(text, apart + "[A-Z]*+-[0-9]+" + ENDS), "ticket"),
        kind(all_of(text, r"https?://\S+"), "url"),
    )


def temporal(text: Column, as_of: Column) -> Column:
    """Struct (phrase, start, end) or null: a known phrase, else a date, else after/before and two words."""
    low = F.lower(text)
    kind = "struct<phrase:string,start:timestamp,end:timestamp>"
    days = [
        F.when(low.contains(p), F.struct(F.lit(p).alias("phrase"), ((F.date_trunc("day", as_of) if d < 2 else as_of) - F.make_dt_interval(F.lit(d))).alias("start"), as_of.alias("end")))
        for p, d in PHRASE_DAYS.items()
    ]
    day = F.try_to_timestamp(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("yyyy-MM-dd"))
    dated = F.when(day.isNotNull(), F.struct(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("phrase"), day.alias("start"), (day + F.make_dt_interval(F.lit(1))).alias("end")))
    rel = F.regexp_extract(low, r"((after|before) \w+ [0-9]+)", 1)
    loose = F.when(rel != "", F.struct(rel.alias("phrase"), F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end")))
    return F.coalesce(*(x.cast(kind) for x in [*days, dated, loose]))


def channels(text: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.concat(*(all_of(low, p, 1) for p in CHANNEL_PATTERNS)))


def users(text: Column) -> Column:
    return F.array_distinct(F.concat(all_of(text, USER_PATTERN, 1), all_of(F.lower(text), BY_PATTERN, 1)))


def code_intent(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for part in CODE_PARTS:
        out = out | low.contains(part)
    return out


def question_type(text: Column) -> Column:
    low = F.trim(F.lower(text))
    out = F.when(low.startswith(QUESTION_WORDS[0]), QUESTION_WORDS[0])
    for w in QUESTION_WORDS[1:]:
        out = out.when(low.startswith(w), w)
    return out.when(low.contains("?"), "question").otherwise("statement")


def expansions(text: Column) -> Column:
    """The text, its normal form if it differs from the text in lower case, and likewise what is left of it without
    question words, if anything; without repeats."""
    low = F.lower(text)
    bare = F.trim(F.regexp_replace(low, words_pattern(REMOVED_WORDS) + r"\s*", ""))
    variants = [text, F.when(normalized(text) != low, normalized(text)), F.when((bare != "") & (bare != low), bare)]
    return F.array_distinct(F.array_compact(F.array(*variants)))


def analysis(text: Column, as_of: Column) -> Column:
    """All that is known of a query, as one struct."""
    return F.struct(
        text.alias("original_query"), normalized(text).alias("normalized_query"), intents(text).alias("intents"), entities(text).alias("entities"), temporal(text, as_of).alias("temporal"),
        channels(text).alias("channels"), users(text).alias("users"), code_intent(text).alias("has_code_intent"), question_type(text).alias("question_type"),
    )
