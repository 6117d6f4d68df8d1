"""Frames from sentences by a pluggable extractor (PIP-03, 28, 30) and the rule-based default (STR-30)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.align import aligned
from ..sources.views import ROLES

#: takes a sentence, returns the frame as JSON text; may raise
Extractor = Callable[[str], str]
FAILED = "EXTRACTION_FAILED"
SCHEMA = "frame_id string, doc_id string, line int, kriya string, " + ", ".join(f"{r} string" for r in ROLES) + ", sentence string, status string, error string, attempts int"

# The role that a preposition gives to what follows it.
PREPOSITIONS = {"to": "sampradana", "for": "sampradana", "from": "apadana", "with": "karana", "using": "karana", "by": "karta", "about": "locus_topic", "in": "locus", "at": "locus", "on": "locus", "during": "locus_time"}
_BE = {"is", "are", "was", "were", "be", "been", "being"}
_CUT = re.compile(r"\b(" + "|".join(PREPOSITIONS) + r")\s+", re.I)


def _locus(filler: str) -> str:
    low = filler.lower()
    if re.search(text.TIME_PATTERN, low):
        return "locus_time"
    return "locus_space" if filler[:1].isupper() or re.search(text.PLACE_PATTERN, low) else "locus_topic"


def by_rule(sentence: str) -> str:
    """STR-30: active subject acts on the object; passive subject is the object and a by-phrase acts, if there is one.

    The verb is the first known action word or word in ``-ed``; prepositions give the other roles; the first filler of
    a role stays.  A sentence without such a verb raises ``ValueError``.
    """
    words = sentence.strip().rstrip(".!?").split()
    at = next((i for i, w in enumerate(words) if i and (w.lower() in text.ACTION_WORDS or (len(w) > 3 and w.lower().endswith("ed")))), None)
    if at is None:
        raise ValueError("no verb found")
    passive = words[at - 1].lower() in _BE
    subject = " ".join(words[: at - 1 if passive else at])
    head, *phrases = _CUT.split(" " + " ".join(words[at + 1 :]))
    roles = {"karma": subject} if passive else {"karta": subject, "karma": head.strip()}
    for preposition, filler in zip(phrases[::2], phrases[1::2], strict=True):
        role = PREPOSITIONS[preposition.lower()]
        role = _locus(filler) if role == "locus" else role
        roles.setdefault(role, filler.strip())
    return json.dumps({"kriya": words[at].lower(), **{r: f for r, f in roles.items() if f}}, ensure_ascii=False)


def attempt(extractor: Extractor, sentence: str, retries: int) -> tuple[dict | None, str | None, int]:
    """PIP-28: the frame, the last error and the number of calls; at most ``retries`` calls after the first, at once."""
    error = None
    for n in range(1, retries + 2):
        try:
            frame = json.loads(extractor(sentence))
            if not isinstance(frame, dict) or not frame.get("kriya"):
                raise ValueError("reply holds no kriya")
            if any(isinstance(frame.get(r), list | dict) for r in ROLES):
                raise ValueError("a role holds several values")
            return frame, None, n
        except Exception as e:  # whatever an extractor raises becomes a failure row  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
    return None, error, retries + 1


def extract_frames(sentences: DataFrame, extractor: Extractor = by_rule, retries: int = 2) -> DataFrame:
    """PIP-03: one frame for each row of ``sentences(doc_id, line, sentence)``; failures stay as rows with an error.

    Blank and null sentences give no frame.  The extractor runs on the executors, in batches that Arrow bounds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, line, s in b[["doc_id", "line", "sentence"]].itertuples(index=False):
                frame, error, n = attempt(extractor, s, retries)
                f = frame or {"kriya": FAILED}
                fillers = [None if f.get(r) is None else str(f[r]) for r in ROLES]
                rows.append([f"{doc}_L{line}", doc, line, str(f["kriya"]), *fillers, s, "failed" if frame is None else "ok", error, n])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    spoken = sentences.where(text.strip(F.col("sentence")) != "")
    return spoken.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("line").cast("int").alias("line"), "sentence").mapInPandas(run, SCHEMA)


def split_by(proposer: Callable[[str, str | None], list[str]], original: str, retries: int = 2) -> list[str]:
    """PIP-30: sentences that a proposer finds, aligned with the text; it is asked again with feedback.

    If all tries fail, the longest prefix of the first proposal that aligns stays and the rest is proposed anew; a
    text of which nothing aligns stays whole.
    """
    out, rest = [], original
    while rest.strip():
        feedback, first = None, None
        for _ in range(retries + 1):
            try:
                proposed = proposer(rest, feedback)
            except Exception as e:  # noqa: BLE001
                feedback = f"{type(e).__name__}: {e}"
                continue
            first = proposed if first is None else first
            got = aligned(rest, proposed)
            if got is not None:
                return out + got
            feedback = "the sentences must repeat the text exactly and in order"
        sure = None
        for n in range(len(first or []) - 1, 0, -1):
            sure = aligned(rest, first[:n], leftover=len(rest))
            if sure:
                break
        if not sure:
            return [*out, rest]
        out += sure
        at = 0
        for s in sure:
            at = rest.index(s, at) + len(s)
        rest = rest[at:].lstrip()
    return out
