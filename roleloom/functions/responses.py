"""Columns over model replies: lenient JSON, shapes, token usage, reasoning mode (FN-12..14, 16..18, 20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def _slice(raw: Column, pattern: str) -> Column:
    return text.filled(F.regexp_extract(raw, pattern, 0))


def lenient_json(raw: Column) -> Column:
    """FN-12: VARIANT of the JSON in a reply; null if there is none.

    Code fences go.  From the first bracket to the last, then the outermost braces, then the outermost square
    brackets are parsed; each is tried again without commas before a closing bracket.  An object that holds a list
    stays an object.
    """
    bare = F.regexp_replace(raw, "```(?:json)?", "")
    tries = [_slice(bare, p) for p in (r"(?s)[\[{].*[\]}]", r"(?s)\{.*\}", r"(?s)\[.*\]")]
    repaired = [F.regexp_replace(t, r",\s*([}\]])", "$1") for t in tries]
    return F.coalesce(*[F.try_parse_json(t) for pair in zip(tries, repaired, strict=True) for t in pair])


# An object, and an array, with at most one level inside.
OBJECT_PATTERN = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
ARRAY_PATTERN = r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]"


def first_json(raw: Column) -> Column:
    """FN-13: text of the first object with at most one level inside, else such an array, else the reply itself."""
    return F.coalesce(_slice(raw, OBJECT_PATTERN), _slice(raw, ARRAY_PATTERN), raw)


def answer_json(raw: Column) -> Column:
    """FN-14: VARIANT of the outermost braces; a reply without a valid object becomes ``{"answer": reply}``."""
    return F.coalesce(F.try_parse_json(_slice(raw, r"(?s)\{.*\}")), F.try_parse_json(F.to_json(F.struct(raw.alias("answer")))))


def extractions(reply: Column) -> Column:
    """FN-16: the extractions of a parsed reply as array of VARIANT: a list, the list under ``extractions``, or one
    object with a ``verb``.  Null for other shapes, no extraction, or a role that holds a list."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    found = F.coalesce(
        get(reply, "$", "array<variant>"),
        get(reply, "$.extractions", "array<variant>"),
        F.when(get(reply, "$.verb", "variant").isNotNull(), F.array(reply)),
    )
    roles = lambda e: F.coalesce(F.map_values(get(e, "$.karakas", "map<string,variant>")), F.array().cast("array<variant>"))
    lists = F.exists(found, lambda e: F.exists(roles(e), lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))))
    return F.when((F.size(found) > 0) & ~lists, found)


def candidate_id(index: Column) -> Column:
    """FN-16: ``Candidate_A`` for generation 0 and so on; numbers of rejected generations stay unused."""
    return F.concat(F.lit("Candidate_"), F.char(index + 65))


def role_rows(roles: Column) -> Column:
    """FN-17: explodes a map of roles into ``role, filler``; empty fillers are left out."""
    kept = F.filter(F.map_entries(roles), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    return F.inline(F.transform(kept, lambda e: F.struct(e["key"].alias("role"), e["value"].alias("filler"))))


def token_usage(reply: Column, provider: Column) -> Column:
    """FN-18: prompt, completion and total tokens as the provider reports them; for other providers an estimate."""
    n = lambda field: F.coalesce(F.try_variant_get(reply, f"$.usage.{field}", "bigint"), F.lit(0).cast("bigint"))
    said = lambda field: F.coalesce(F.try_variant_get(reply, f"$.{field}", "string"), F.lit(""))
    row = lambda a, b, c: F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens"), c.alias("total_tokens"))
    prompt, completion = said("prompt"), said("completion")
    return (
        F.when(provider.isin("openai", "nvidia"), row(n("prompt_tokens"), n("completion_tokens"), n("total_tokens")))
        .when(provider == "anthropic", row(n("input_tokens"), n("output_tokens"), n("input_tokens") + n("output_tokens")))
        .otherwise(row(text.token_estimate(prompt), text.token_estimate(completion), text.token_estimate(F.concat(prompt, completion))))
    )


def reasoning_mode(asked: Column, provider_can: Column, model_can: Column, model_default: Column) -> Column:
    """FN-20: ``on`` if both can and it is asked for, or left to a model whose default is on."""
    wanted = (asked == "on") | ((asked == "auto") & (model_default == "on"))
    return F.when(provider_can & model_can & wanted, "on").otherwise("off")
