"""Rolling conversation memory: messages are folded in batches, by a function that may be a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

STATE = "summary string, seen long, held array<string>"
OUT = "conv_id long, summary string, seen long"


def concise(summary: str, batch: list[str]) -> str:
    """The default fold: the newest words, deterministic and bounded."""
    return " ".join((summary + " " + " ".join(batch)).split()[-120:])


def fold_stream(messages: DataFrame, fold: Callable[[str, list[str]], str] = concise, batch: int = 12) -> DataFrame:
    """(conv_id, summary, seen) whenever a conversation gets messages (conv_id, turn, role, text): ``fold`` takes what
    was summed up and the next ``batch`` messages; messages short of a batch wait in the state."""

    def step(key, frames, state):
        import pandas as pd

        summary, seen, held = state.get if state.exists else ("", 0, [])
        rows = pd.concat(list(frames)).sort_values(["turn", "role", "text"])
        held = list(held) + [f"{r}: {t[:4000]}" for r, t in zip(rows["role"], rows["text"])]
        while len(held) >= batch:
            summary, held, seen = fold(summary, held[:batch]), held[batch:], seen + batch
        state.update((summary, seen, held))
        yield pd.DataFrame({"conv_id": [key[0]], "summary": [summary], "seen": [seen]})

    return messages.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")
