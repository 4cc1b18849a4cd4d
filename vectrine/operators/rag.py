"""Context, prompts and language-model providers."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROMPT = "Context passages:\n\n{context}\n\nQuestion: {question}\n\nAnswer from the passages above, and from what you know where they are silent."
SIMULATED = "This is a simulated answer from the LLM based on the retrieved context."


def context(hits: DataFrame, by: str = "qid", text: str = "text") -> DataFrame:
    """Texts of each query's hits in order of rank, with a blank line between; there are k hits at most."""
    parts = F.array_sort(F.collect_list(F.struct("rank", text)))
    return hits.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("context"))


def prompts(contexts: DataFrame, questions: DataFrame, by: str = "qid") -> DataFrame:
    """(by, prompt) for questions (by, question); a question without hits has an empty context."""
    joined = questions.join(contexts, by, "left")
    head, rest = PROMPT.split("{context}")
    middle, tail = rest.split("{question}")
    return joined.select(
        by, F.concat(F.lit(head), F.coalesce("context", F.lit("")), F.lit(middle), F.col("question"), F.lit(tail)).alias("prompt")
    )


class LLM(Protocol):
    def ask(self, prompt: str, **options: Any) -> str: ...


class Simulated:
    """Needs no model; always the same answer."""

    def ask(self, prompt: str, **options: Any) -> str:
        return SIMULATED


class Remote:
    """A provider with a JSON interface over HTTP."""

    def __init__(self, url: str, body: Callable[[str, dict], dict], pick: Callable[[dict], str], headers: dict[str, str] | None = None):
        self.url, self.body, self.pick, self.headers = url, body, pick, headers or {}

    def ask(self, prompt: str, **options: Any) -> str:
        request = urllib.request.Request(
            self.url, json.dumps(self.body(prompt, options)).encode(), {"Content-Type": "application/json", **self.headers}
        )
        with urllib.request.urlopen(request, timeout=300) as answer:
            return self.pick(json.load(answer))


BUDGETS = ("low", "medium", "high")


def options_for(provider: str, model: str, options: dict[str, Any]) -> dict[str, Any]:
    """A provider's names for temperature, length and thinking budget (low, medium or high)."""
    out = {k: v for k, v in options.items() if k not in ("thinking_budget", "max_tokens", "temperature")}
    budget, limit, heat = options.get("thinking_budget"), options.get("max_tokens", 1000), options.get("temperature", 0.7)
    if budget is not None and budget not in BUDGETS:
        raise ValueError(f"thinking_budget is one of {', '.join(BUDGETS)}")
    if provider == "openai":
        reasons = model[:2] in ("o1", "o3", "o4")
        out |= {"max_completion_tokens": limit, "temperature": 1.0} if reasons else {"max_tokens": limit, "temperature": heat}
        if budget and reasons:
            out["reasoning_effort"] = budget
    elif provider == "ollama":
        out["options"] = {"temperature": heat, "num_predict": limit}
        if budget:
            out["think"] = budget
    else:
        out |= {"max_new_tokens": limit, "temperature": heat, "do_sample": heat > 0}
    return out


def _openai(model: str) -> LLM:
    return Remote(
        "https://api.openai.com/v1/chat/completions",
        lambda p, o: {"model": model, "messages": [{"role": "user", "content": p}], **options_for("openai", model, o)},
        lambda a: a["choices"][0]["message"]["content"].strip(),
        {"Authorization": f"Bearer {os.environ.get('OPENAI_API_KEY', '')}"}
    )


def _ollama(model: str) -> LLM:
    return Remote(
        os.environ.get("OLLAMA_HOST", "http://localhost:11434") + "/api/generate",
        lambda p, o: {"model": model, "prompt": p, "stream": False, **options_for("ollama", model, o)},
        lambda a: a["response"]
    )


def _gemini(model: str) -> LLM:
    return Remote(
        f"https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent",
        lambda p, o: {"contents": [{"parts": [{"text": p}]}]},
        lambda a: a["candidates"][0]["content"]["parts"][0]["text"],
        {"x-goog-api-key": os.environ.get("GEMINI_API_KEY", "")}
    )


class Local:
    """A text-generation pipeline in this process; greedy at temperature 0."""

    def __init__(self, model: str):
        from transformers import pipeline  # optional

        self.model, self.pipe = model, pipeline("text-generation", model=model)

    def ask(self, prompt: str, **options: Any) -> str:
        text = prompt + (" /no_think" if "qwen" in self.model.lower() and not options.get("thinking_budget") else "")
        return self.pipe([{"role": "user", "content": text}], **options_for("hf", self.model, options))[0]["generated_text"][-1]["content"]


#: type -> factory of a model's name; may be extended
PROVIDERS: dict[str, Callable[[str], LLM]] = {
    "simulated": lambda model: Simulated(), "openai": _openai, "ollama": _ollama, "gemini": _gemini, "hf": Local
}


def llm(config: dict[str, str] | None = None) -> LLM:
    config = config or {"type": "openai", "model": "gpt-4o"}
    kind = config.get("type", "openai")
    if kind not in PROVIDERS:
        raise ValueError(f"unknown LLM type {kind!r}; known: {', '.join(PROVIDERS)}")
    return PROVIDERS[kind](config.get("model", ""))
