"""Calls to an external text generator, as rows: retries, checks, costs, and a client that needs no network."""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.config import Config

RETRY_STATUS = frozenset((408, 409, 425, 429, 500, 502, 503, 504))


class FatalError(RuntimeError):
    """What no retry mends, such as spent credit: it fails the job."""


class RetryableError(RuntimeError):
    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


@dataclass
class Completion:
    text: str
    prompt_tokens: int
    completion_tokens: int
    cost_usd: float | None = None
    finish_reason: str = "stop"


class Client(Protocol):
    """complete() returns a completion, or raises RetryableError or FatalError."""

    def complete(self, model: str, system: str, user: str, seed: int, **options: Any) -> Completion: ...


def outcome_of_status(status: int, message: str = "", after: float | None = None) -> None:
    """Raise what an HTTP status means; nothing for success."""
    if status in RETRY_STATUS:
        raise RetryableError(f"{status}: {message}", after)
    if status >= 400:
        raise FatalError(f"{status}: {message}")


def backoff(attempt: int, rng: random.Random, base: float = 2.0, most: float = 60.0, after: float | None = None) -> float:
    """Seconds before the next try: what the server says, or an exponential with jitter."""
    return min(most, after) if after is not None else min(most, base**attempt) * (0.5 + rng.random() / 2)


def completed(client: Client, tries: int, rng: random.Random, sleep: Callable[[float], None] = time.sleep, **call: Any) -> Completion:
    """client.complete() with retries."""
    for attempt in range(1, tries + 1):
        try:
            return client.complete(**call)
        except RetryableError as e:
            if attempt == tries:
                raise
            sleep(backoff(attempt, rng, after=e.after))
    raise AssertionError


def cost_of(c: Completion, price_prompt: float, price_completion: float) -> float:
    """The provider's figure, or tokens times prices."""
    return c.cost_usd if c.cost_usd is not None else c.prompt_tokens * price_prompt + c.completion_tokens * price_completion


@dataclass
class DryRun:
    """Sentences of made-up words, as many and as long as asked for: the same for the same request in any process."""

    word: str = "වචන"

    def complete(self, model: str, system: str, user: str, seed: int, sentences: int = 1, words: int = 8, **_: Any) -> Completion:
        rng = random.Random(zlib.crc32(f"{model}\0{user}\0{seed}".encode()))
        sizes = [words // sentences + (i < words % sentences) for i in range(sentences)]
        said = " ".join(" ".join(self.word + "කගචජතදනපබමයරලවස"[rng.randrange(15)] * rng.randint(1, 3) for _ in range(max(1, n))) + "." for n in sizes)
        return Completion(said, len(user.split()), len(said.split()), 0.0)


def render(template: str, fields: dict[str, Any]) -> str:
    """A template with its fields; a missing one raises."""
    return template.format(**fields)


def word_bounds(target: int, tolerance: float) -> tuple[int, int]:
    return round(target * (1 - tolerance)), round(target * (1 + tolerance))


_OUT = (
    "record_id string, attempts int, passed boolean, pieces array<array<string>>, "
    "rejections array<struct<attempt:int,span:int,errors:array<string>,output:string>>, prompt_tokens long, completion_tokens long, cost_usd double"
)


def generate(tasks: DataFrame, client: Callable[[], Client], cfg: Config | None = None, prompt: str = "{context}\n[{sentences} sentences, {low}-{high} words]", system: str = "", tries: int = 5, interval: float = 0.0, check: Callable[[str, int, int, str | None], list[str]] | None = None) -> DataFrame:
    """(record_id, attempts, passed, pieces, rejections, tokens, cost) of tasks with plans.

    tasks: record_id, generator, sentences, spans, targets. A span is asked for
    until its text passes the checks, `cfg.validate.attempts` times at most
    with another seed each; a span that never does leaves its record without
    text. A fatal error fails the job. Rows are all that a task gives back:
    nothing is appended to shared files. One client is made in each task, and
    calls in it start `interval` seconds apart, so partitions set the rate.
    """
    cfg = cfg or Config()
    gens, attempts, tolerance, seed = cfg.generators, cfg.validate.attempts, cfg.validate.length_tolerance, cfg.seed
    test = check or default_check(cfg)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from seamline.functions.segment import Segmenter

        api, cut, last = client(), Segmenter(cfg.segment), 0.0
        for f in frames:
            rows = []
            for r in f.itertuples():
                g = gens[r.generator]
                pieces, rejected, tokens, cost, used = [], [], [0, 0], 0.0, 0
                for k, (span, target) in enumerate(zip(r.spans, r.targets, strict=True)):
                    want = " ".join(target)
                    low, high = word_bounds(len(want.split()), tolerance)
                    context = " ".join(list(r.sentences)[max(0, span["start"] - 3) : span["start"]])
                    user = render(prompt, {"context": context, "sentences": len(target), "low": low, "high": high})
                    for a in range(attempts):
                        time.sleep(max(0.0, last + interval - time.monotonic()))
                        last = time.monotonic()
                        c = completed(api, tries, random.Random(f"{r.record_id}:{k}:{a}"), model=g.slug, system=system, user=user, seed=seed + 1000 * a, sentences=len(target), words=len(want.split()), temperature=g.temperature, top_p=g.top_p, max_tokens=g.max_tokens)
                        used += 1
                        tokens[0] += c.prompt_tokens
                        tokens[1] += c.completion_tokens
                        cost += cost_of(c, g.price_prompt, g.price_completion)
                        errors = test(c.text, len(target), len(want.split()), None)
                        if not errors:
                            pieces.append(cut(c.text))
                            break
                        rejected.append({"attempt": a, "span": k, "errors": errors, "output": c.text})
                    else:
                        break
                passed = len(pieces) == len(r.spans)
                rows.append((r.record_id, used, passed, pieces if passed else None, rejected, *tokens, cost))
            yield pd.DataFrame(rows, columns=["record_id", "attempts", "passed", "pieces", "rejections", "prompt_tokens", "completion_tokens", "cost_usd"])

    return tasks.select("record_id", "generator", "sentences", "spans", "targets").mapInPandas(run, _OUT)


def default_check(cfg: Config) -> Callable[[str, int, int, str | None], list[str]]:
    """Counts of sentences and words, within the configured tolerances."""

    def check(text: str, sentences: int, words: int, original: str | None) -> list[str]:
        from seamline.functions.segment import Segmenter

        if not text.strip():
            return ["empty: model returned no text"]
        n, w = len(Segmenter(cfg.segment)(text)), len(text.split())
        low, high = words * (1 - cfg.validate.length_tolerance), words * (1 + cfg.validate.length_tolerance)
        out = [] if abs(n - sentences) <= cfg.validate.sentence_tolerance else [f"sentence_count: got {n}, expected {sentences}"]
        return out if low <= w <= high else [*out, f"length: {w} words outside {low:.0f}-{high:.0f} (target {words})"]

    return check


def pending(tasks: DataFrame, done: DataFrame, key: str = "record_id", limit: int | None = None) -> DataFrame:
    """Tasks whose key isn't written yet; with a limit, the first by key."""
    rest = tasks.join(done.select(key), key, "left_anti")
    return rest if limit is None else rest.orderBy(key).limit(limit)


def price_drift(prices: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(generator, slug, problem) of generators whose slug is unknown or whose prices differ; prices: slug, prompt, completion."""
    cfg = cfg or Config()
    own = prices.sparkSession.createDataFrame([(n, g.slug, g.price_prompt, g.price_completion) for n, g in cfg.generators.items()], "generator string, slug string, _p double, _c double")
    joined = own.join(prices, "slug", "left")
    moved = (F.abs(F.col("prompt") - F.col("_p")) > 1e-12) | (F.abs(F.col("completion") - F.col("_c")) > 1e-12)
    problem = F.when(F.col("prompt").isNull(), "missing").when(moved, "drift")
    return joined.select("generator", "slug", problem.alias("problem")).where(F.col("problem").isNotNull())
