"""Text and scalar column builders (STR-*, FN-*).  Pure expressions, no actions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and patterns whose exact content the results depend on.
PRONOUNS = ["he", "she", "it", "they", "him", "her", "his", "hers", "its", "their", "theirs", "which", "that", "who", "whom", "this", "these", "those"]
ACTION_WORDS = ["ate", "ran", "went", "said", "made", "gave", "took", "came", "saw", "got", "put", "found", "told", "asked", "used", "tried", "left", "called"]
STATIVE_PATTERNS = [r"\bis\s+a\b", r"\bare\s+the\b", r"\bwas\s+a\b", r"\bwere\s+the\b", r"\bis\s+an\b", r"\bhas\s+been\b"]
METAPHOR_PATTERNS = [r"king of \w+", r"lord of \w+", r"master of \w+", r"father of \w+", r"mother of \w+", r"son of \w+", r"daughter of \w+", r"\w+ the \w+"]
COMPLETED_WORDS = ["completed", "succeeded", "done", "finished"]
FAILED_WORDS = ["failed", "error", "stopped"]
PROCESSING_WORDS = ["processing", "running", "in_progress", "processing_kg", "queued"]
INTERROGATIVES = [("from where", "apadana"), ("from whom", "apadana"), ("to whom", "sampradana"), ("for whom", "sampradana"), ("with what", "karana"), ("by whom", "karta"), ("about what", "locus_topic"), ("who", "karta"), ("whom", "karma"), ("what", "karma"), ("how", "karana"), ("when", "locus_time"), ("where", "locus_space")]


def strip(text: Column) -> Column:
    """Removes white space of any kind at both ends (SQL trim removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def key(text: Column) -> Column:
    """STR-01: lower case, stripped."""
    return strip(F.lower(text))


def filled(text: Column) -> Column:
    """Null for the empty string."""
    return F.when(text != "", text)


def canonical_text(f: dict[str, Column]) -> Column:
    """STR-02: ``[karta ]kriya[ karma][ using karana][ about topic]``; empty parts are left out."""
    return F.concat_ws(
        " ", filled(f["karta"]), filled(f["kriya"]), filled(f["karma"]), F.concat(F.lit("using "), filled(f["karana"])), F.concat(F.lit("about "), filled(f["locus_topic"]))
    )


def sentences(text: Column) -> Column:
    """STR-03: lossless split after ``.!?`` and the white space that follows."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(.+?(?:(?<=[.!?])\s+|\z))"), F.lit(1))


def smart_sentences(text: Column) -> Column:
    """STR-05: the split if it has more than one part, blank text gives none, else the text itself."""
    parts = sentences(text)
    return F.when(strip(text) == "", F.array().cast("array<string>")).when(F.size(parts) > 1, parts).otherwise(F.array(text))


def lossless(parts: Column, text: Column) -> Column:
    """STR-04."""
    return F.concat_ws("", parts) == text


def paragraphs(text: Column) -> Column:
    """STR-08."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def abbreviation_sentences(text: Column, abbreviations: list[str]) -> Column:
    """STR-06/07: sentences, joined again where the first ends in an abbreviation."""
    known = "|".join(a.rstrip(".").replace(".", r"\.") for a in abbreviations)
    return F.split(F.regexp_replace(text, rf"(?s)(?<!\b(?:{known}))([.!?])\s+", "$1\u0001"), "\u0001")


def windows_of(tokens: Column, size: int, overlap: int) -> Column:
    """STR-10: token windows; the last one ends at the end."""
    step = max(1, size - overlap)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i + (size - step) < F.size(tokens)))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, size))


def normalised_sentence(text: Column) -> Column:
    """STR-14: white space collapsed, typographic quotes made plain."""
    return strip(F.regexp_replace(F.translate(text, "“”‘’", "\"\"''"), r"\s+", " "))


def sentence_hash(text: Column) -> Column:
    """FN-06."""
    return F.sha2(normalised_sentence(text), 256)


def token_estimate(text: Column) -> Column:
    """STR-18: a quarter of the length, at least 1, 0 for none."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def fill_template(template: Column, values: Column) -> Column:
    """STR-19: ``{VAR}`` by the entries of a map; unknown names stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def is_pronoun(text: Column) -> Column:
    """STR-21."""
    return key(text).isin(PRONOUNS)


def is_metaphor(text: Column) -> Column:
    """STR-22: one of the patterns anywhere in the lower-cased text."""
    return F.lower(text).rlike("(?U)" + "|".join(METAPHOR_PATTERNS))


def eventive(text: Column) -> Column:
    """FLT-08: false for stative sentences without an action word, else unknown (null)."""
    low = F.lower(text)
    acts = F.arrays_overlap(F.split(low, r"\s+"), F.array(*map(F.lit, ACTION_WORDS)))
    return F.when(low.rlike("(?U)" + "|".join(STATIVE_PATTERNS)) & ~acts, F.lit(False))


def reasoning(text: Column) -> Column:
    """STR-23: the first think or reasoning block, empty if there is none."""
    both = F.regexp_extract(text, r"(?s)<(think|reasoning)>(.*?)</\1>", 2)
    return strip(both)


def _speaks_of(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def status(raw: Column) -> Column:
    """STR-24: the first of completed, failed, processing, uploading, pending that the raw status speaks of, else unknown."""
    kinds = [("completed", COMPLETED_WORDS), ("failed", FAILED_WORDS), ("processing", PROCESSING_WORDS), ("uploading", ["upload"]), ("pending", ["pending"])]
    return F.coalesce(*[F.when(_speaks_of(raw, words), kind) for kind, words in kinds], F.lit("unknown"))


def question_kind(q: Column) -> Column:
    """STR-25."""
    s = F.lower(q)
    has = lambda w: F.contains(s, F.lit(w))
    out = F.when(has("who") | has("agent"), "agent").when(has("what") & (has("happen") | has("did")), "event")
    return out.when(has("where"), "location").when(has("when"), "time").when(has("how"), "method").otherwise("general")


def asked_role(q: Column) -> Column:
    """STR-26: role of the first interrogative in the list that the question holds; several words come first."""
    s = F.lower(q)
    out = F.lit(None).cast("string")
    for phrase, role in reversed(INTERROGATIVES):
        out = F.when(s.rlike(rf"\b{phrase}\b"), role).otherwise(out)
    return out


def keywords(q: Column) -> Column:
    """STR-27: words of more than three characters."""
    return F.filter(F.split(q, r"\s+"), lambda w: F.length(w) > 3)


# Error codes and what their messages hold, first match decides.
ERROR_CODES = [
    ("LLM_TIMEOUT", "timeout"),
    ("LLM_RATE_LIMIT", "rate limit|429"),
    ("LLM_TOKEN_LIMIT", "(?s)token.*limit|limit.*token"),
    ("LLM_AUTH_ERROR", "authentication|401"),
    ("LLM_CONNECTION_ERROR", "connection|network"),
    ("LLM_RESPONSE_PARSE_ERROR", "json|parse"),
]


def error_code(message: Column) -> Column:
    """STR-28: the code of the first rule that the message meets, else ``LLM_UNKNOWN_ERROR``."""
    said = F.lower(message)
    return F.coalesce(*[F.when(said.rlike(pattern), code) for code, pattern in ERROR_CODES], F.lit("LLM_UNKNOWN_ERROR"))


def valid_score(raw: Column) -> Column:
    """FN-09: an integer from 1 to 100 (fractions are cut), else null."""
    n = F.floor(raw.try_cast("double")).cast("int")
    return F.when(n.between(1, 100), n)


# What a date or duration, and what a place, looks like.
TIME_PATTERN = r"\d{4}|\d{1,2}:\d{2}|\b(january|february|march|april|may|june|july|august|september|october|november|december)\b|\b(mon|tues|wednes|thurs|fri|satur|sun)day\b|\b(second|minute|hour|day|week|month|year|morning|evening|night|yesterday|today|tomorrow)s?\b"
PLACE_PATTERN = r"\b(city|town|village|house|room|institute|university|forest|river|garden|palace|street|country)\b"


def locus(filler: Column, in_gazetteer: Column) -> Column:
    """STR-29: is it a time? else a place? else a topic."""
    low = F.lower(filler)
    return F.when(low.rlike(TIME_PATTERN), "locus_time").when(F.coalesce(in_gazetteer, F.lit(False)) | low.rlike(PLACE_PATTERN), "locus_space").otherwise("locus_topic")


def question_key(q: Column) -> Column:
    """STR-31: lower case, stripped, without question marks at the end."""
    return F.regexp_replace(key(q), r"\?+$", "")


# The quantity words of a type.
QUANTITIES = {"universal": ["all", "every", "each"], "existential": ["some"], "negative": ["no", "none"], "proportional": ["most", "many", "few"]}
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def quantity(phrase: Column) -> Column:
    """PIP-29: ``quantity, quantity_type, polarity`` of a phrase by its first word; nulls and positive if it has none."""
    first = F.split(key(phrase), r"\s+")[0]
    number = F.when(first.rlike(r"^\d+$"), first).otherwise(F.nullif(F.array_position(F.array(*map(F.lit, NUMBERS)), first).cast("string"), F.lit("0")))
    kind, value = F.when(number.isNotNull(), "exact"), number
    for name, words in QUANTITIES.items():
        hit = first.isin(words)
        kind, value = F.when(hit, name).otherwise(kind), F.when(hit, "ZERO" if name == "negative" else F.upper(first)).otherwise(value)
    negative = F.coalesce(first.isin(QUANTITIES["negative"]), F.lit(False))
    return F.struct(value.alias("quantity"), kind.alias("quantity_type"), F.when(negative, "negative").otherwise("positive").alias("polarity"))


def polarity(sentence: Column) -> Column:
    """PIP-29: what a negation covers: a cause (``not because``), the event, or nothing."""
    low = F.lower(sentence)
    return F.when(low.rlike(r"\bnot because\b"), "cause").when(low.rlike(r"\b(not|never)\b|n't\b"), "event").otherwise("none")


# Verb forms that speak for a tense, aspect and mood, first match decides.
LAKARAS = [(r"\bwould have\b", "lṛṅ"), (r"\b(should|might|may|could|would)\b", "liṅ"), (r"\b(will|shall)\b", "lṛṭ"), (r"\b(has|have) \w+(ed|en)\b", "liṭ"), (r"\b(was|were) \w+ing\b", "laṅ"), (r"\b\w+ed\b", "luṅ")]


def lakara(sentence: Column) -> Column:
    """PIP-37: tense-aspect-mood tag; a bare verb with an exclamation mark is an imperative, else the present."""
    low, out = F.lower(sentence), F.when(strip(sentence).rlike(r"^\p{L}+!$"), "loṭ").otherwise("laṭ")
    for pattern, tag in reversed(LAKARAS):
        out = F.when(low.rlike(pattern), tag).otherwise(out)
    return out


def compound(name: Column) -> Column:
    """PIP-37: head and modifiers of a compound name (``blue-eyed man``) and its kind: possessive, coordinative or
    determinative; null kind for a single word."""
    words = F.split(key(name), r"\s+")
    kind = F.when(F.lower(name).rlike(r"\w-\w+ed\b"), "possessive").when(F.lower(name).rlike(r"\w (and|&) \w"), "coordinative").when(F.size(words) > 1, "determinative")
    return F.struct(F.element_at(words, -1).alias("head"), F.slice(words, F.lit(1), F.size(words) - 1).alias("modifiers"), kind.alias("kind"))


def squared_distance(a: Column, b: Column) -> Column:
    """FN-05."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """FN-03: null if a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(T.DoubleType())
def fidelity(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR-13: matching-block ratio after NFKC, white-space collapse and lower case."""
    norm = lambda x: " ".join(unicodedata.normalize("NFKC", x or "").split()).lower()
    return pd.Series([difflib.SequenceMatcher(None, norm(x), norm(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def normalised_verb(surface: Column, proposed: Column, known: Column) -> Column:
    """STR-32: the proposed root if the lexicon knows it, else the surface verb with a flag."""
    fine = F.coalesce(known, F.lit(False))
    return F.struct(F.when(fine, proposed).otherwise(surface).alias("root"), (~fine).alias("normalisation_failed"))


def safe_chunks(limit: int = 1500):
    """STR-09: parts of at most ``limit`` characters, cut at the last blank line, else line end, sentence end, or hard."""

    def cut(t: str) -> list[str]:
        out = []
        while len(t) > limit:
            head = t[:limit]
            at = head.rfind("\n\n")
            if at > 0:
                out.append(t[:at])
                t = t[at:].lstrip()
                continue
            at = head.rfind("\n")
            if at > 0:
                out.append(t[:at])
                t = t[at:].lstrip()
                continue
            at = max(head.rfind(x) for x in (". ", "! ", "? "))
            at = at + 1 if at > 0 else limit
            out.append(t[:at])
            t = t[at:]
        return [*out, t] if t else out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cut(t or ""))

    return run
