"""Text scalars: tokenizers, sentences, names, guards, redaction, time stamps. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words and their digits.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
}
WORD = "[a-z0-9][a-z0-9'-]*"


def lexical_tokens(text: Column) -> Column:
    """Lower-case tokens; a number word is followed by its digits. Null text gives null."""
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    spelt = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(w.isin(*NUMBER_WORDS), F.array(w, F.element_at(table, w))).otherwise(F.array(w))))
    # bound as the one element of an array, so that the words are taken from the text once
    bound = F.transform(F.array(words), lambda ws: F.when(F.arrays_overlap(ws, F.array(*map(F.lit, NUMBER_WORDS))), spelt(ws)).otherwise(ws))
    return bound[0]


#: Words that never are keywords.
STOP_WORDS = (
    "the a an and or but if then of to in on at for with by is are was were be been being it its this that these those as from into about over under "
    "he she they we you i not no do does did so such than there here what when where which who whom will would can could should may might must have has had "
    "our your their my me us them very just also more most some any all one two three now well okay right like get got go going know think say said how why "
    "let look see lets going want need make made take put use used using thing things really actually"
).split()
KEYWORD = "[A-Za-z][A-Za-z0-9'-]+"


def keyword_tokens(text: Column, least: int = 3) -> Column:
    """Lower-case content words of at least ``least`` characters that are no stop words."""
    # A-Z are lowered before the words are taken: within them there are no other letters, and one pass replaces a call for each
    words = F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(KEYWORD), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*dict.fromkeys(STOP_WORDS)))


def sentences(text: Column) -> Column:
    """The text cut after . ! or ? before white space; pieces are trimmed, empty ones go."""
    pieces = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: s != "")


def quote(text: Column, limit: int = 220) -> Column:
    """A short text as it is; of a longer one what stands before the last space within the limit, with three dots."""
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.*) .*$", "$1"), F.lit("...")))


def redact(text: Column, limit: int | None = None) -> Column:
    """The text, or its first ``limit`` characters as error messages have them, with whatever looks like a credential replaced. Null is empty."""
    out = F.coalesce(text, F.lit(""))
    if limit is not None:
        out = F.substring(out, 1, limit)
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, "[redacted]")
    return out


#: Shapes of credentials.
SECRETS = (
    r"\b(sk-or-v1-|sk-|gsk_|hf_|ghp_|xox[baprs]-)[A-Za-z0-9_\-]{8,}",
    r"(?i)\b(api[_-]?key|authorization|bearer|token|password|secret)\b\s*[:=]\s*\S+",
)


def guard_formula(cell: Column) -> Column:
    """A cell that a spreadsheet would run as a formula, made plain text by a leading quote."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def slug(title: Column, fallback: str = "untitled") -> Column:
    """At most 80 ASCII letters, digits, dots, underscores and hyphens."""
    stem = F.regexp_replace(F.coalesce(title, F.lit("")), "[^A-Za-z0-9._-]+", "-")
    stem = F.substring(F.regexp_replace(stem, r"^[-.]+|[-.]+$", ""), 1, 80)
    return F.when(stem == "", fallback).otherwise(stem)


def clean_title(raw: Column, limit: int = 160) -> Column:
    """Without control characters and angle brackets, white space collapsed, cut."""
    plain = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\x00-\x1f\x7f<>]", " "))
    return F.substring(F.regexp_replace(plain, r"\s+", " "), 1, limit)


def clean_cue(text: Column) -> Column:
    """White space collapsed; an empty cue becomes three dots, as a blank line would end it."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(body == "", "...").otherwise(body)


def clock(seconds: Column) -> Column:
    """m:ss.f, or h:mm:ss.f from an hour on, cut to tenths."""
    t = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(t)
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    frac = F.floor((t - whole) * 10)
    return F.when(h > 0, F.format_string("%d:%02d:%02d.%d", h, m, s, frac)).otherwise(F.format_string("%d:%02d.%d", m, s, frac))


def cue_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds, rounded."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def iso_utc(ts: Column) -> Column:
    """A time without zone, taken as UTC, in ISO form with its offset; microseconds only where there are any. Null is empty."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.coalesce(F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00")), F.lit(""))


def parse_time(text: Column) -> Column:
    """Seconds of h:mm:ss.mmm (or a comma), else of a plain number, else 0."""
    part = lambda k: F.regexp_extract(text, r"(\d+):(\d{2}):(\d{2})[.,](\d{1,3})", k)
    found = part(1) != ""
    whole = part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")
    spelt = (whole * 1000 + F.rpad(part(4), 3, "0").try_cast("long")) / 1000.0
    return F.when(found, spelt).otherwise(F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0)))


def suppressed(ranked_terms: Column, limit: int) -> Column:
    """The first terms of a ranked array, skipping those that contain, or are contained in, one already taken."""
    return F.aggregate(
        ranked_terms,
        F.array().cast("array<string>"),
        lambda acc, t: F.when((F.size(acc) >= limit) | F.exists(acc, lambda c: F.contains(c, t) | F.contains(t, c)), acc).otherwise(F.concat(acc, F.array(t))),
    )


#: Phrases that show what a question is after.
CUES = {
    "visual": r"\b(show|shows|showing|shown|display|displayed|appear|appears|visible|on screen|onscreen|slide|slides|diagram|chart|graph|figure|table|whiteboard|demo|screenshot|image|frame|picture|visual|wearing|color|colour|logo|animation)\b",
    "temporal": r"\b(when|what time|timestamp|at which point|moment|first time|last time|before|after|during|how long|duration|earliest|latest)\b",
    "compute": r"\b(calculate|compute|how much|how many|total|sum|average|mean|median|growth|yoy|year over year|cagr|percent|percentage|difference|increase|decrease|ratio|rate|per|times|compare numerically)\b",
    "attribution": r"\b(who|speaker|said|says|asked|answered|presenter|host|panelist)\b",
    "summary": r"\b(summar|overview|recap|tl;?dr|key points|main points|takeaway|agenda|outline)\b",
    "compare": r"\b(compare|versus|vs\.?|difference between|contrast|better|worse)\b",
    "chart": r"\b(chart|graph|plot|table|axis|bar|line|pie|figures|numbers on)\b",
}


def intent_flags(question: Column) -> dict[str, Column]:
    return {k: question.rlike(f"(?i){p}") for k, p in CUES.items()}


def answer_style(flags: dict[str, Column]) -> Column:
    return F.when(flags["compute"], "numeric").when(flags["chart"], "table").when(flags["summary"], "narrative").otherwise("timestamped")


#: Words that point back, order words, and words without a subject of their own.
PRONOUNS = r"(?i)\b(it|its|that|this|those|these|they|them|their|there|he|she|him|her|his|hers|same)\b"
ORDER_WORDS = r"(?i)\b(first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th|last|final|previous|next)\b"
QUESTION_STOP = (
    "the a an and or but if then of to in on at for with by is are was were be been being it its this that these those as from into about over under "
    "what when where which who how why does did do said say show shows tell me you your their there here more most some any all can could would should will "
    "other else again same thing things one ones part parts"
).split()
SCAFFOLDING = (
    "say said says mention mentioned talk talked tell told speak spoke discuss discussed cover covered happen happened come came go goes went right just "
    "exactly specifically more else again about thing things one ones part parts bit next"
).split()


def content_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9'-]{2,}"), F.lit(0)), lambda w: ~w.isin(*QUESTION_STOP))


def leans_on_context(question: Column) -> Column:
    """Whether a question needs what was said before: it has a pronoun, or an order word and at most one subject, or no subject."""
    subjects = F.size(F.filter(content_words(question), lambda w: ~w.isin(*SCAFFOLDING)))
    return question.rlike(PRONOUNS) | (question.rlike(ORDER_WORDS) & (subjects <= 1)) | (subjects == 0)


def subsequence_score(needle: Column, haystack: Column) -> Column:
    """1000 less the place of a substring; else points for each character found in order, more in a streak or at a word's start; -1 for a miss."""
    n, h = F.lower(needle), F.lower(haystack)
    start = F.struct(F.lit(0).alias("score"), F.lit(1).alias("at"), F.lit(0).alias("streak"), F.lit(True).alias("ok"))

    def step(acc, ch):
        found = F.call_function("locate", ch, h, acc["at"])
        streak = F.when(found == acc["at"], acc["streak"] + 1).otherwise(F.lit(0))
        opens = (found == 1) | (F.substring(h, found - 1, F.lit(1)) == " ")
        return F.struct(
            (acc["score"] + 10 + 5 * streak + F.when(opens, 8).otherwise(0)).cast("int").alias("score"),
            (found + 1).cast("int").alias("at"),
            streak.cast("int").alias("streak"),
            (acc["ok"] & (found > 0)).alias("ok"),
        )

    walked = F.aggregate(F.regexp_extract_all(n, F.lit("(?s)."), F.lit(0)), start, step, lambda a: F.when(a["ok"], a["score"]).otherwise(-1))
    return F.when(n == "", 1).when(F.contains(h, n), 1001 - F.call_function("locate", n, h)).otherwise(walked)
