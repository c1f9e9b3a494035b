"""Model-backed steps behind small interfaces, with deterministic defaults that need no server.

An own provider is any object with the same method; it is created once per Python worker from a factory.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from traceloom.config import SETTINGS, STATUSES

DIMENSIONS = 64


class Embedder(Protocol):
    """May have ``max_chars``: longer texts go to it in parts of that length, and the parts' vectors are added."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    """``attempt`` counts from 1; ``errors`` are those of the answer before."""

    def extract(self, text: str, errors: list[str], attempt: int, source: str, locator: str) -> str: ...


class Classifier(Protocol):
    """``evidence``: blocks of a head line and a text.  Returns a status, or None if there is no valid one."""

    def classify(self, requirement: str, evidence: list[str]) -> str | None: ...


class ChatModel(Protocol):
    """A chat model behind a server; ``available`` tells whether it answers."""

    def chat(self, messages: list[dict[str, str]]) -> str: ...

    def available(self) -> bool: ...


def available(provider: object) -> bool:
    """Whether a provider answers; one without a check always does, an error in the check counts as no."""
    try:
        return bool(getattr(provider, "available", lambda: True)())
    except Exception:  # noqa: BLE001 - whatever a client raises
        return False


def asked(model: ChatModel, messages: list[dict[str, str]]) -> str:
    """The model's answer; an error of the model is an empty one, so it counts as a failed attempt and stops no task."""
    try:
        return model.chat(messages) or ""
    except Exception:  # noqa: BLE001 - whatever a client raises
        return ""


_TASK = """You read parts of project documents and list what they say about requirements.
Answer with a JSON list only.  Each item has entity_type (REQUIREMENT, IMPLEMENTATION or EVALUATION), entity_id, text (words of the document), linked_requirement (the id it belongs to, or ""), author and timestamp (or null).  Nothing found: []."""
_EXAMPLES = """Examples
Text: R7: The import must keep row order.
Answer: [{"entity_type": "REQUIREMENT", "entity_id": "R7", "text": "The import must keep row order.", "linked_requirement": "", "author": null, "timestamp": null}]
Text: Lena closed R7 yesterday, the import keeps the order now.
Answer: [{"entity_type": "IMPLEMENTATION", "entity_id": "I-R7", "text": "the import keeps the order now", "linked_requirement": "R7", "author": "Lena", "timestamp": null}]"""


def extraction_messages(text: str, source: str = "", locator: str = "", attempt: int = 1, errors: list[str] = (), max_chars: int | None = None) -> list[dict[str, str]]:
    """The messages of an attempt: the task with examples, then the task with the errors of the answer before, then the shortest form.

    The whole text is sent unless the model states a limit (``max_chars``).
    """
    part = text if max_chars is None else text[:max_chars]
    body = f"Document: {source}\nPlace: {locator}\n\n{part}"
    if attempt == 1:
        return [{"role": "system", "content": f"{_TASK}\n\n{_EXAMPLES}"}, {"role": "user", "content": body}]
    if attempt == 2:
        listed = "\n".join(f"- {e}" for e in errors)
        return [{"role": "system", "content": _TASK}, {"role": "user", "content": f"Your last answer had errors:\n{listed}\nAnswer again, correctly.\n\n{body}"}]
    return [{"role": "user", "content": f"List requirements, implementations and evaluations of this text as JSON items with entity_type, entity_id, text, linked_requirement; [] if none.\n\n{part}"}]


class PromptedExtractor:
    def __init__(self, model: ChatModel, max_chars: int | None = None):
        self.model, self.max_chars = model, max_chars

    def extract(self, text: str, errors: list[str], attempt: int = 1, source: str = "", locator: str = "") -> str:
        return asked(self.model, extraction_messages(text, source, locator, attempt, errors, self.max_chars))


def classification_messages(requirement: str, evidence: list[str]) -> list[dict[str, str]]:
    system = f"You judge how far a requirement is met by the evidence shown.  Answer with one JSON object: status, one of {', '.join(STATUSES)}, and reasoning."
    return [{"role": "system", "content": system}, {"role": "user", "content": f"Requirement: {requirement}\n\n{len(evidence)} text(s):\n\n" + "\n\n".join(evidence)}]


def parse_label(answer: str) -> tuple[str, str] | None:
    """(status, reasoning) of a classifier's answer: its JSON object, else the first one in it; a status with other words around it counts."""
    text = answer.strip()
    for part in (text, (m := re.search(r"\{.*?\}", text, re.S)) and m.group()):
        try:
            read = json.loads(part or "")
        except ValueError:
            continue
        said = str(read.get("status") or "").strip() if isinstance(read, dict) else ""
        label = said if said in STATUSES else next((s for s in STATUSES if s.lower() in said.lower()), None)
        return (label, str(read.get("reasoning") or "")) if label else None
    return None


class PromptedClassifier:
    """A chat model asked up to ``attempts`` times for a valid label."""

    def __init__(self, model: ChatModel, attempts: int = 2):
        self.model, self.attempts = model, attempts

    def classify(self, requirement: str, evidence: list[str]) -> str | None:
        for _ in range(self.attempts):
            if label := parse_label(asked(self.model, classification_messages(requirement, evidence))):
                return label[0]
        return None


class HashingEmbedder:
    """Words hashed into signed buckets, brought to length 1."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), DIMENSIONS))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % DIMENSIONS] += 1.0 if h >> 16 & 1 else -1.0
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32).tolist()


class RuleExtractor:
    """Sentences with a requirement id become requirements, claims or verdicts by their words."""

    def extract(self, text: str, errors: list[str] = (), attempt: int = 1, source: str = "", locator: str = "") -> str:
        found = []
        for s in re.split(r"(?<=[.!?])\s+", text):
            m = re.search(r"\b(?:R|REQ-|NFR-)\d+\b", s)
            if m:
                low = s.lower()
                kind = "EVALUATION" if re.search(r"rated|score|review", low) else "IMPLEMENTATION" if re.search(r"implement|built|closed|merged", low) else "REQUIREMENT"
                found.append({"entity_type": kind, "entity_id": m.group(), "text": s.strip(), "linked_requirement": "" if kind == "REQUIREMENT" else m.group()})
        return json.dumps(found)


class OverlapClassifier:
    """The label follows the share of the requirement's words that the evidence (without its head lines) holds."""

    def classify(self, requirement: str, evidence: list[str]) -> str:
        words = set(re.findall(r"\w+", requirement.lower()))
        seen = set(re.findall(r"\w+", "\n".join(e.partition("\n")[2] for e in evidence).lower()))
        share = len(words & seen) / len(words) if words else 0.0
        return "IMPLEMENTED_WITHOUT_EVALUATION" if share >= 0.7 else "PARTIALLY_IMPLEMENTED" if share >= 0.4 else "CLAIMED_BUT_NO_EVIDENCE"


def embedding(text: Column, factory: Callable[[], Embedder] = HashingEmbedder, retries: int = 3) -> Column:
    """Vectors of whole texts in Arrow batches.

    A text beyond the limit of the model (``max_chars``; without it there is none) is embedded in parts: their vectors,
    each weighted with its length, are added and brought to length 1.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        limit = getattr(model, "max_chars", None)
        for batch in batches:
            texts = [t or "" for t in batch]
            parts = [[t] if not limit else [t[i : i + limit] for i in range(0, len(t), limit)] or [""] for t in texts]
            flat = [p for own in parts for p in own]
            for attempt in range(retries):
                try:
                    vectors = model.embed(flat) if flat else []
                    break
                except ConnectionError:
                    if attempt == retries - 1:
                        raise
            out, at = [], 0
            for own in parts:
                if len(own) == 1:
                    out.append(vectors[at])
                else:
                    v = np.average(np.array(vectors[at : at + len(own)], float), axis=0, weights=[len(p) for p in own])
                    norm = np.sqrt((v * v).sum())
                    out.append((v / norm if norm > 0 else v).astype(np.float32).tolist())
                at += len(own)
            yield pd.Series(out)

    return embed(text)


def answer_errors(answer: str) -> list[str]:
    """What is wrong with an answer as a whole: no readable JSON, or items of which none is valid.  None of both: it is a success."""
    from traceloom.operators.extraction import read_answer

    items, errors = read_answer(answer)
    return [] if items is not None and (items or not errors) else errors


ANSWER = "struct<answer:string,attempts:int,errors:array<string>>"


def extract_answers(text: Column, source: Column | None = None, locator: Column | None = None, factory: Callable[[], Extractor] = RuleExtractor, attempts: int = SETTINGS.max_extraction_retries) -> Column:
    """A struct (answer, attempts, errors): a model is asked again, with the errors, until its answer is valid or ``attempts`` are spent.

    After the last failed attempt the answer is ``[]`` and the errors are those of that attempt.  Null texts count as empty.
    """

    @F.pandas_udf(ANSWER)
    def extract(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts, sources, locators in batches:
            rows = []
            for t, s, p in zip(texts, sources, locators):
                errors: list[str] = []
                for attempt in range(1, attempts + 1):
                    answer = model.extract(t or "", errors, attempt, s or "", p or "")
                    errors = answer_errors(answer)
                    if not errors:
                        break
                rows.append((answer if not errors else "[]", attempt, errors))
            yield pd.DataFrame(rows, columns=["answer", "attempts", "errors"])

    none = F.lit("")
    return extract(text, none if source is None else source, none if locator is None else locator)


def classify(requirement: Column, evidence: Column, factory: Callable[[], Classifier] = OverlapClassifier) -> Column:
    """A status per requirement and its evidence texts; NULL without a requirement text, not implemented without evidence."""

    @F.pandas_udf(StringType())
    def label(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for texts, blocks in batches:
            yield pd.Series([None if not t else "REQUIREMENT_NOT_IMPLEMENTED" if b is None or not len(b) else model.classify(t, list(b)) for t, b in zip(texts, blocks)])

    return label(requirement, evidence)
