"""K3, K9 in context: a hidden Markov tagger over a caller's lexicon.

The lexicon ``(term, tag, weight)`` says how often a term carries a tag; it
gives the emissions.  The transitions between tags are learned from untagged
text: every round joins nothing and shuffles only expected counts, tags x tags
a task, from a forward and a backward pass over each document.  ``tag`` then
names the likeliest tags of each document as a whole (Viterbi).

Emissions meet the tokens once, in a join on the term that Spark may split,
and are stored; a document is one unit of work, batched with others position by
position in numpy.  Only the model (tags x tags numbers) is on the driver, so
the tags of a lexicon must be few.

Defined results: a term the lexicon lacks may carry any tag; null tokens and
documents without tokens have no row; ids are unique; equal paths go to the tag
first in the order of names; a lexicon without rows raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .vocab import explode_tokens, listed


@dataclass(frozen=True)
class TagModel:
    tags: tuple[str, ...]
    start: np.ndarray              # tags
    step: np.ndarray               # tags x tags, rows sum to 1


def emissions(df: DataFrame, lexicon: DataFrame, tags: tuple[str, ...], id_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``(id_col, tokens, e)``: ``e`` holds, token after token, the share of each tag's weight that is this term."""
    whole = lexicon.groupBy("tag").agg(F.sum("weight").alias("_all"))
    share = lexicon.groupBy("term", "tag").agg(F.sum("weight").alias("_w")).join(whole, "tag")
    per_tag = [F.coalesce(F.max(F.when(F.col("tag") == t, F.col("_w") / F.col("_all"))), F.lit(0.0)) for t in tags]
    rows = listed(share.groupBy("term").agg(F.array(*per_tag).alias("_e")))
    long = explode_tokens(df, (id_col,), tokens).join(rows, "term", "left")
    long = long.withColumn("_e", F.coalesce("_e", F.array(*[F.lit(1.0)] * len(tags))))
    docs = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "term", "_e"))).alias("_p"))
    return docs.select(id_col, F.transform("_p", lambda x: x["term"]).alias(tokens), F.flatten(F.transform("_p", lambda x: x["_e"])).alias("e"))


def _groups(e: list, k: int, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents by falling length in groups of ``limit`` tokens (or one longer document): row numbers, lengths, emissions."""
    size = np.array([len(x) // k for x in e])
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        end, total = at + 1, size[order[at]]
        while end < len(order) and total + size[order[end]] <= limit:
            total += size[order[end]]
            end += 1
        rows = order[at:end]
        yield rows, size[rows], np.concatenate([np.asarray(e[r], float).reshape(-1, k) for r in rows])
        at = end


def expected_counts(e: list, model: TagModel) -> np.ndarray:
    """``(tags + 1) x tags``: expected first tags, then expected steps between tags."""
    k = len(model.tags)
    out = np.zeros((k + 1, k))
    for _, size, flat in _groups(e, k):
        off = np.concatenate([[0], np.cumsum(size)[:-1]])
        fwd, scale, emit = [], [], []
        for p in range(size[0]):
            live = int(np.searchsorted(-size, -p, side="left"))          # documents longer than p
            x = flat[off[:live] + p]
            a = x * (model.start if p == 0 else fwd[-1][:live] @ model.step)
            c = a.sum(axis=1, keepdims=True)
            fwd.append(a / c)
            scale.append(c)
            emit.append(x)
        back = np.ones_like(fwd[-1])
        for p in range(size[0] - 1, 0, -1):
            ahead = emit[p] * back / scale[p]
            out[1:] += model.step * (fwd[p - 1][:len(ahead)].T @ ahead)
            back = np.ones_like(fwd[p - 1])                              # documents that end here
            back[:len(ahead)] = ahead @ model.step.T
        out[0] += (fwd[0] * back).sum(axis=0)
    return out


def best_tags(e: list, model: TagModel) -> list[list[str]]:
    """The likeliest tags of each document."""
    k = len(model.tags)
    found: list = [None] * len(e)
    with np.errstate(divide="ignore"):
        start, step = np.log(model.start), np.log(model.step)
        for rows, size, flat in _groups(e, k):
            off = np.concatenate([[0], np.cumsum(size)[:-1]])
            score, came = [], []
            for p in range(size[0]):
                live = int(np.searchsorted(-size, -p, side="left"))
                x = np.log(flat[off[:live] + p])
                if p == 0:
                    score.append(start + x)
                    continue
                paths = score[-1][:live, :, None] + step[None]
                came.append(paths.argmax(axis=1))
                score.append(paths.max(axis=1) + x)
            for n, r in enumerate(rows):
                t = int(score[size[n] - 1][n].argmax())
                path = [t]
                for p in range(size[n] - 2, -1, -1):
                    t = int(came[p][n, t])
                    path.append(t)
                found[r] = [model.tags[t] for t in reversed(path)]
    return found


def tag_names(lexicon: DataFrame) -> tuple[str, ...]:
    tags = tuple(sorted(r["tag"] for r in lexicon.select("tag").distinct().collect()))       # few, by contract
    if not tags:
        raise ValueError("the lexicon has no tags")
    return tags


def fit(df: DataFrame, lexicon: DataFrame, rounds: int = 5, prior: float = 1.0, id_col: str = "doc_id", tokens: str = "tokens",
        seen: DataFrame | None = None) -> TagModel:
    """Transitions by ``rounds`` of expectation and maximisation; ``prior`` is added to every count.

    ``seen``: the stored ``emissions`` of ``df``, where the caller has them."""
    tags = tag_names(lexicon)
    k = len(tags)
    model = TagModel(tags, np.full(k, 1 / k), np.full((k, k), 1 / k))
    seen = seen.select("e") if seen is not None else pinned(emissions(df, lexicon, tags, id_col, tokens).select("e"))
    for _ in range(rounds):
        def counts(batches, model=model):
            total = np.zeros((k + 1, k))
            for b in batches:
                total += expected_counts(list(b["e"]), model)
            yield pd.DataFrame({"i": np.repeat(np.arange(k + 1), k), "j": np.tile(np.arange(k), k + 1), "n": total.ravel()})
        sums = seen.mapInPandas(counts, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
        n = np.full((k + 1, k), prior)
        for r in sums:
            n[r["i"], r["j"]] += round(r["n"], 6)
        n /= n.sum(axis=1, keepdims=True)
        model = TagModel(tags, n[0], n[1:])
    return model


def tag(df: DataFrame, lexicon: DataFrame, model: TagModel, id_col: str = "doc_id", tokens: str = "tokens",
        seen: DataFrame | None = None) -> DataFrame:
    """``(id_col, tokens, tags)``: one tag a token; ``seen`` as for ``fit``."""
    if seen is None:
        seen = emissions(df, lexicon, model.tags, id_col, tokens)
    kind = dict(df.dtypes)[id_col]

    def named(batches):
        for b in batches:
            b["tags"] = best_tags(list(b["e"]), model)
            yield b[[id_col, tokens, "tags"]]
    return seen.mapInPandas(named, f"`{id_col}` {kind}, `{tokens}` array<string>, tags array<string>")


def keep_tags(tagged: DataFrame, start: str = "NN", tokens: str = "tokens") -> DataFrame:
    """K3 in context: tokens whose tag begins with ``start``, in order."""
    kept = F.filter(F.arrays_zip(F.col(tokens).alias("w"), F.col("tags").alias("t")), lambda x: x["t"].startswith(start))
    return tagged.withColumn(tokens, F.transform(kept, lambda x: x["w"])).drop("tags")
