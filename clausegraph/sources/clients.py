"""Clients of language models, for the driver only: retries, caps, and streams split into thinking and answer."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

# Status codes that are worth another try, and the caps of a stream.
RETRIED = (429, 500, 502, 503, 504)
MOST_SECONDS, MOST_CHARS = 180.0, 200_000


class Failed(RuntimeError):
    def __init__(self, status: int, text: str = ""):
        super().__init__(f"status {status} {text}".strip())
        self.status = status


def retrying(call: Callable[[], str], tries: int = 5, base: float = 0.5, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str:
    """call(), again after growing pauses with jitter where its failure is worth it."""
    rng = rng or random.Random()
    for k in range(tries):
        try:
            return call()
        except Failed as e:
            if e.status not in RETRIED or k == tries - 1:
                raise
            sleep(base * 2**k * (1 + rng.random()))
    raise AssertionError


def capped(parts: Iterable[str], seconds: float = MOST_SECONDS, chars: int = MOST_CHARS, clock: Callable[[], float] = time.monotonic) -> Iterator[str]:
    """The parts of a stream until it runs too long or says too much."""
    began, said = clock(), 0
    for part in parts:
        if clock() - began > seconds or said >= chars:
            return
        yield part[: chars - said]
        said += len(part)


OPEN, CLOSE = "<think>", "</think>"


def _whole(text: str, mark: str) -> int:
    """How much of the text can't be the beginning of a mark that the next part completes."""
    return len(text) - max(k for k in range(len(mark)) if text.endswith(mark[:k]))


class _Splitter:
    """Takes a stream's text as it comes and gives it back as (kind, text), by one of three readers in turn."""

    def __init__(self) -> None:
        self.text, self.read = "", self.opening

    def opening(self, last: bool) -> list[tuple[str, str]]:
        """Before anything is said: only white space may stand before the block."""
        bare = self.text.lstrip()
        if len(bare) < len(OPEN) and OPEN.startswith(bare) and not last:
            return []
        self.read = self.thought if bare.startswith(OPEN) else self.said
        self.text = bare.removeprefix(OPEN) if self.read == self.thought else self.text
        return self.read(last)

    def thought(self, last: bool) -> list[tuple[str, str]]:
        inside, closed, after = self.text.partition(CLOSE)
        if closed:
            self.text, self.read = after, self.gap
            return [("thinking", inside), *self.gap(last)]
        n = len(inside) if last else _whole(inside, CLOSE)
        self.text = inside[n:]
        return [("thinking", inside[:n])]

    def gap(self, last: bool) -> list[tuple[str, str]]:
        """White space between the block and the answer is dropped."""
        self.text = self.text.lstrip()
        self.read = self.said if self.text else self.gap
        return self.said(last)

    def said(self, last: bool) -> list[tuple[str, str]]:
        out, self.text = self.text, ""
        return [("answer", out)]


def split_thinking(parts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """('thinking' or 'answer', text) of a stream whose answer may follow a think block; tags may be cut between parts."""
    splitter = _Splitter()
    for part in _ended(parts):
        splitter.text += part or ""
        yield from (x for x in splitter.read(part is None) if x[1])


def _ended(parts: Iterable[str]) -> Iterator[str | None]:
    yield from parts
    yield None


def collect(events: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The events of one answer, folded by kind."""
    out: dict[str, list[str]] = {}
    for kind, text in events:
        out.setdefault(kind, []).append(text)
    return {k: "".join(v) for k, v in out.items()}


@dataclass
class Router:
    """Backends by the start of a model's name; the empty name is the default."""

    backends: dict[str, Callable[[str, str], str]] = field(default_factory=dict)

    def __call__(self, model: str, prompt: str) -> str:
        name = max((k for k in self.backends if model.startswith(k)), key=len, default=None)
        if name is None:
            raise Failed(404, f"no backend for {model}")
        return retrying(lambda: self.backends[name](model, prompt))


def offline(model: str, prompt: str) -> str:
    """A backend without a model: the first sentence of the prompt's context that has most of the question's words."""
    context, _, question = prompt.rpartition("\nQuestion:")
    asked = set(re.findall(r"\w+", question.lower()))
    sentences = re.split(r"(?<=[.!?])\s+", context[max(0, context.find("[1]")) :])
    return max(sentences, key=lambda s: len(asked & set(re.findall(r"\w+", s.lower()))), default="")


def prompt(question: str, context: list[tuple[str, str]], force: bool = False, warnings: list[str] | None = None) -> str:
    """A grounded prompt: numbered clauses, what is out of scope, the question."""
    rule = "Answer from the numbered clauses and cite them as [n]." + ("" if force else " If they do not cover the question, say 'Context does not cover'.")
    parts = [rule, *(f"Note: {w}." for w in warnings or []), *(f"[{i}] {title}\n{text}" for i, (title, text) in enumerate(context, 1))]
    return "\n\n".join(parts) + f"\nQuestion: {question}"


def first_json(text: str) -> dict | None:
    """The first balanced JSON object in a text, whatever stands around it."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text[m.start() :])
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def classify(ask: Callable[[str], str], question: str, intents: Iterable[str], fallback: Callable[[str], str]) -> dict:
    """{'intent', 'terms', 'by'}: a model's answer where it is a JSON object with a known intent and a list of strings, else the fallback's intent and no terms."""
    try:
        said = first_json(ask(f"Reply with JSON: intent (one of {', '.join(intents)}) and terms (a list of names).\nQuestion: {question}")) or {}
    except Failed:
        said = {}
    terms = said.get("terms")
    if said.get("intent") in tuple(intents) and isinstance(terms, list) and all(isinstance(t, str) for t in terms):
        return {"intent": said["intent"], "terms": [t.strip() for t in terms if t.strip()], "by": "model"}
    return {"intent": fallback(question), "terms": [], "by": "rules"}


def asks_whole_flow(ask: Callable[[str], str], question: str) -> bool:
    """Whether a model says, in a JSON object, that a question asks for a whole procedure; no if it says nothing of the kind."""
    try:
        said = first_json(ask(f"Reply with JSON: whole_flow (true or false), whether the question asks for a procedure from begin to end.\nQuestion: {question}")) or {}
    except Failed:
        return False
    return said.get("whole_flow") is True


def choose_root(ask: Callable[[str], str], question: str, headings: list[tuple[str, str]]) -> str | None:
    """The id of one of the headings (id, title), best first, that a model names by its number; the first of them where it names none."""
    if not headings:
        return None
    listed = "\n".join(f"{i}. {title}" for i, (_, title) in enumerate(headings, 1))
    try:
        number = re.search(r"\d+", ask(f"Reply with the number of the heading that names the procedure.\n{listed}\nQuestion: {question}"))
    except Failed:
        number = None
    at = int(number.group()) if number else 0
    return headings[at - 1][0] if 1 <= at <= len(headings) else headings[0][0]
