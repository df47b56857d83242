"""Calls of a text generator: retry, continuation, batches of titles, carried context.

A generator is any picklable object with ``generate(request: Request, attempt: int) -> str``. A request may carry a file,
such as the pages that a chapter is written from. The generators here work offline and always answer alike; real services
plug in by the same method. Results should be written (``cut``) before they are used twice, since
a lazy plan would call again.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


@dataclass(frozen=True)
class Request:
    """What a model is asked: a prompt, a file with its type, and how to answer."""

    prompt: str
    attachment: bytes | None = None
    attachment_type: str = "application/pdf"
    temperature: float = 0.2
    answer_type: str = "text/plain"


class Generator(Protocol):
    def generate(self, request: Request, attempt: int) -> str: ...


@dataclass(frozen=True)
class Echo:
    """Answers with the part of the prompt after the marker line."""

    change: Callable[[str], str] | None = None

    def generate(self, request: Request, attempt: int) -> str:
        body = request.prompt.partition("\n\n")[2]
        return self.change(body) if self.change else body


@dataclass(frozen=True)
class ReadBack:
    """Answers with the text of the file that comes with a request."""

    def generate(self, request: Request, attempt: int) -> str:
        return (request.attachment or b"").decode("utf-8")


@dataclass(frozen=True)
class Scripted:
    """Answers from a table; a list is read by attempt. Unknown prompts raise."""

    answers: dict

    def generate(self, request: Request, attempt: int) -> str:
        answer = self.answers[request.prompt]
        return answer if isinstance(answer, str) else answer[min(attempt, len(answer)) - 1]


@dataclass(frozen=True)
class Truncating:
    """Gives ``size`` characters of another generator's answer, and on a continuation prompt the next ones."""

    inner: Generator
    size: int

    def generate(self, request: Request, attempt: int) -> str:
        ask, _, so_far = request.prompt.partition(CONTINUE)
        return self.inner.generate(replace(request, prompt=ask), attempt)[len(so_far) :][: self.size]


@dataclass(frozen=True)
class Flaky:
    """Fails on the first ``failures`` attempts."""

    inner: Generator
    failures: int

    def generate(self, request: Request, attempt: int) -> str:
        if attempt <= self.failures:
            raise ConnectionError(f"attempt {attempt}")
        return self.inner.generate(request, attempt)


CONTINUE = "\n\n=== continue behind this ===\n"


@dataclass(frozen=True)
class Policy:
    """``attempts`` counts all calls; an empty answer is tried again; waits grow up to the cap."""

    attempts: int = 3
    cap_seconds: float = 30.0
    sleep: Callable[[float], None] = field(default=time.sleep)

    def call(self, generator: Generator, request: Request | str) -> tuple[str | None, int, str | None]:
        """Answer, attempts used, error."""
        request, error = Request(request) if isinstance(request, str) else request, None
        for attempt in range(1, self.attempts + 1):
            if attempt > 1:
                self.sleep(min(2.0 ** (attempt - 1) + 0.1 * (attempt - 1), self.cap_seconds))
            try:
                answer = generator.generate(request, attempt)
                if answer:
                    return answer, attempt, None
                error = "empty answer"
            except Exception as problem:  # noqa: BLE001  every failure of a remote call is tried again
                error = f"{type(problem).__name__}: {problem}"
        return None, self.attempts, error


def generate(
    frame: DataFrame, prompt_col: str, generator: Generator, policy: Policy = Policy(), attachment_col: str | None = None, like: Request = Request(""),
) -> DataFrame:
    """Adds response, attempts and error; one call for each row, in batches as they come. With ``attachment_col`` a row's file goes
    along and is not returned. ``like`` has the settings of all requests."""
    fields = [f for f in frame.schema.fields if f.name != attachment_col]
    names = [f.name for f in fields]
    schema = StructType([*fields, *(StructField(n, t()) for n, t in (("response", StringType), ("attempts", IntegerType), ("error", StringType)))])

    def ask(prompt, attachment) -> tuple:
        if not isinstance(prompt, str):
            return None, 0, "no prompt"
        return policy.call(generator, replace(like, prompt=prompt, attachment=bytes(attachment) if attachment is not None else None))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            files = pdf[attachment_col] if attachment_col else [None] * len(pdf)
            rows = [ask(p, a) for p, a in zip(pdf[prompt_col], files, strict=True)]
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame(rows, columns=["response", "attempts", "error"], dtype=object)], axis=1)

    return frame.mapInPandas(run, schema)


def _complete(text: str) -> bool:
    return re.search(r"<html.*?>.*?</html>", text, re.S) is not None if "</html>" in text else False


def continued(generator: Generator, policy: Policy, prompt: str, more: int | None) -> tuple[str | None, int, str | None]:
    """An answer and up to ``more`` continuations (None: as long as they add text), until it holds a whole document; a continuation
    that is whole by itself replaces what came before. Text, calls, error (``incomplete`` if it never closed)."""
    text, calls, error = policy.call(generator, prompt)
    while text is not None and not _complete(text) and (more is None or more > 0):
        part, used, error = policy.call(generator, prompt + CONTINUE + text)
        calls, more = calls + used, more and more - 1
        if part is None:
            break
        text = part if _complete(part) else text + part
    if text is not None and not _complete(text):
        error = error or "incomplete"
    return text, calls, error


def translate_items(
    items: DataFrame, generator: Generator, instruction: str, policy: Policy = Policy(), more: int | None = 3, context_limit: int = 0,
) -> DataFrame:
    """Items (book, ordinal, member, html) to response, calls and error.

    Without context items are independent: a flat map over all books. With it, an item's prompt has the first
    ``context_limit`` characters of the answer before, so each book is read in order as a stream, books in parallel.
    """
    schema = "book string, ordinal long, member string, response string, calls int, error string"

    def ask(html: str, before: str) -> tuple:
        context = f"\nBefore: {before}" if before else ""
        return continued(generator, policy, f"{instruction}{context}\n\n{html}", more)

    def flat(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, before = None, ""
        for pdf in parts:
            rows = []
            for b, n, m, html in zip(pdf["book"], pdf["ordinal"], pdf["member"], pdf["html"], strict=True):
                if b != book:
                    book, before = b, ""
                text, calls, error = ask(html or "", before)
                before = (text or "")[:context_limit] if context_limit > 0 else ""
                rows.append((b, n, m, text, calls, error))
            yield pd.DataFrame(rows, columns=["book", "ordinal", "member", "response", "calls", "error"])

    plain = items.select("book", "ordinal", "member", "html")
    if context_limit > 0:
        plain = plain.repartition("book").sortWithinPartitions("book", "ordinal", "member")
    return plain.mapInPandas(flat, schema)


def translate_titles(titles: DataFrame, generator: Generator, instruction: str, policy: Policy = Policy(), size: int = 10, by_position: bool = False) -> DataFrame:
    """Titles (book, ordinal from 1, title) in batches of ``size``, one call each: adds translated.

    Answers are matched by their printed number, or by position; without an answer a title stays.
    """
    from quirelake.functions.text import lines, numbered, strip, strip_number
    from quirelake.operators.relational import zipped

    batch = F.floor((F.col("ordinal") - 1) / size).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "title")))
    asked = titles.groupBy("book", batch.alias("batch")).agg(listed.alias("items"))
    asked = asked.withColumn("texts", F.transform("items", lambda x: x["title"]))
    asked = generate(asked.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), numbered(F.col("texts")))), "prompt", generator, policy)
    answer = lines(strip(F.coalesce("response", F.lit(""))))
    if by_position:
        answers = F.when(F.col("response").isNull(), F.array().cast("array<string>")).otherwise(F.transform(answer, strip_number))
        new = zipped(F.col("texts"), answers)
    else:
        pairs = F.transform(F.filter(answer, lambda x: x.rlike(r"(?U)^\s*\d+\.")), lambda x: F.struct(F.translate(F.regexp_extract(x, r"(?U)^\s*(\d+)\.", 1), "０１２３４５６７８９", "0123456789").try_cast("int").alias("n"), strip_number(strip(x)).alias("t")))
        said = lambda i: F.try_element_at(F.filter(pairs, lambda p: p["n"] == i + 1), F.lit(1))["t"]
        new = F.transform("texts", lambda x, i: F.coalesce(said(i), x))
    rows = asked.select("book", F.posexplode(F.arrays_zip("items", new.alias("new"))).alias("pos", "row"))
    return rows.select("book", F.col("row.items.ordinal").alias("ordinal"), F.col("row.items.title").alias("title"), F.col("row.new").alias("translated"))
