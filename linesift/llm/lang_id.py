"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased; what is no letter becomes one space. Each language's model of order ORDER is fitted on a
bounded sample of labelled rows, so its size is bounded too: at most SAMPLE_CHARS n-grams of each order and
language. All models share the arrays: for each order, a sorted array of n-gram hashes, and a column of log
probabilities (and of back-off weights) per language beside it. A text's languages are compared by their
cross-entropy per character; the lowest wins.

Rejection is calibrated on held-back labelled texts and on the same texts with their letters shuffled. Under the best
language, the cross-entropy of either kind is taken as normal with a variance of a + b / length; a text is rejected
if it is likelier among the shuffled ones. Both curves are fitted, so the rule is smooth in the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, give_back

ORDER = 4
#: Characters of each language that a model is fitted on, at most; a quarter as many, at most, calibrate rejection.
SAMPLE_CHARS = 1_000_000
DISCOUNT = 0.75
CHUNK = 200_000

U = np.uint64
MIX = U(0x9E3779B97F4A7C15)


def letters_of(text: str) -> str:
    """Lower-cased letters, with one space between words and at both ends; empty without letters."""
    low = text.lower()
    if not low.isascii() or not low.isalpha():
        low = "".join(c if c.isalpha() else " " for c in low)
    words = low.split()
    return f" {' '.join(words)} " if words else ""


def grams(code: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n characters that end at each place from n - 1 on."""
    h = np.full(max(0, len(code) - n + 1), n, U)
    for i in range(n):
        h = (h ^ code[i : i + len(h)]) * MIX
        h ^= h >> U(29)
    return h


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts as numbers, and each text's first place (with the total as the last)."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    return code, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


class Model:
    """langs, and for each order n from 1: sorted hashes, log probabilities and log back-off weights (a row a hash, a column a language)."""

    def __init__(self, langs: list[str], orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]], floor: np.ndarray, curves: tuple | None = None):
        self.langs, self.orders, self.floor, self.curves = langs, orders, floor, curves

    def plain(self) -> tuple:
        """Lists and arrays alone, of which Model(*plain) makes the model again where the package isn't installed."""
        return self.langs, self.orders, self.floor, self.curves

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Model:
        langs = sorted(samples)
        tables = []
        for lang in langs:
            code, _ = coded([t for t in samples[lang] if t])
            # An n-gram counts as often as it occurs at the highest order, else as many characters as precede it.
            spans = []
            for n in range(1, ORDER + 1):
                h = grams(code, n)
                hashes, at, count = np.unique(h, return_index=True, return_counts=True)
                spans.append((hashes, at, count))
            kn = [None] * ORDER
            kn[ORDER - 1] = spans[ORDER - 1][2].astype(float)
            for n in range(ORDER - 1, 0, -1):  # kinds of continuation: each (n+1)-gram vouches once for its suffix
                longer_at = spans[n][1]
                suffix = grams(code, n)[longer_at + 1]
                i = np.searchsorted(spans[n - 1][0], suffix)
                kn[n - 1] = np.maximum(np.bincount(i, minlength=len(spans[n - 1][0])), 1).astype(float)
            tables.append((code, spans, kn))
        letters = np.unique(np.concatenate([t[0] for t in tables]))
        size = len(letters) + 1
        floor = np.full(len(langs), np.log(1 / size))
        orders = []
        lower = None  # (hashes, log probabilities) of the order below
        for n in range(1, ORDER + 1):
            union = np.unique(np.concatenate([t[1][n - 1][0] for t in tables]))
            # For each n-gram of any language: the hash of its suffix and of its context.
            suffix, context = np.zeros(len(union), U), np.zeros(len(union), U)
            for code, spans, _ in tables:
                at = np.searchsorted(union, spans[n - 1][0])
                if n > 1:
                    short = grams(code, n - 1)
                    suffix[at], context[at] = short[spans[n - 1][1] + 1], short[spans[n - 1][1]]
            logp = np.empty((len(union), len(langs)))
            weight = []
            for k, (code, spans, kn) in enumerate(tables):
                count = np.zeros(len(union))
                count[np.searchsorted(union, spans[n - 1][0])] = kn[n - 1]
                if n == 1:
                    total, kinds = count.sum(), (count > 0).sum()
                    p = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds / size) / max(total, 1)
                    floor[k] = np.log(max(DISCOUNT * kinds / size / max(total, 1), 1e-12))
                    logp[:, k] = np.log(p)
                else:
                    below = lower[0]
                    c = np.searchsorted(below, context)
                    total = np.bincount(c, count, minlength=len(below))
                    kinds = np.bincount(c[count > 0], minlength=len(below))
                    lam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                    weight.append(np.log(lam))
                    under = np.exp(lower[1][np.searchsorted(below, suffix), k])
                    logp[:, k] = np.log(np.maximum(count - DISCOUNT, 0) / np.maximum(total[c], 1) + lam[c] * under)
            if n > 1:
                orders[-1] = (orders[-1][0], orders[-1][1], np.stack(weight, 1).astype(np.float32))
            orders.append((union, logp.astype(np.float32), None))
            lower = (union, logp)
        return cls(langs, orders, floor)

    def log_probs(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each character after the ORDER - 1 before it; a row a character, a column a language."""
        out = np.zeros((len(code), len(self.langs)), np.float32)
        left = np.arange(len(code))
        h = {n: grams(code, n) for n in range(1, ORDER + 1)}
        for n in range(ORDER, 0, -1):
            hashes, logp, _ = self.orders[n - 1]
            able = left >= n - 1
            mine = h[n][left[able] - n + 1]
            at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
            hit = hashes[at] == mine
            out[left[able][hit]] += logp[at[hit]]
            rest = np.concatenate((left[~able], left[able][~hit]))
            if n > 1:
                back = rest[rest >= n - 1]  # unseen after this context: its back-off weight, if it was seen at all
                below, _, weight = self.orders[n - 2]
                ctx = h[n - 1][back - n + 1]
                at = np.minimum(np.searchsorted(below, ctx), len(below) - 1)
                known = below[at] == ctx
                out[back[known]] += weight[at[known]]
            else:
                out[rest] += self.floor.astype(np.float32)
            left = rest
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy in nats a character of each (non-empty) text under each language."""
        out = np.empty((len(texts), len(self.langs)))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            code, first = coded(texts[i:j])
            out[i:j] = -np.add.reduceat(self.log_probs(code).astype(float), first[:-1], axis=0) / np.diff(first)[:, None]
            i = j
        return out

    def calibrate(self, held: list[str]) -> None:
        """Fit the curves of the texts and of their shuffled letters; without texts, nothing will be rejected."""
        held = [t for t in held if t.strip()]
        if not held:
            return
        rng = np.random.default_rng(1)
        shuffled = [f" {' '.join(''.join(rng.permutation(list(t[1:-1]))).split())} " for t in held]
        curves = []
        for texts in (held, shuffled):
            e, long = self.entropies(texts), np.array([len(t) for t in texts])
            best, low = e.argmin(1), e.min(1)
            mean = np.array([np.median(low[best == k]) if (best == k).any() else np.median(low) for k in range(len(self.langs))])
            spread = np.linalg.lstsq(np.stack([np.ones(len(long)), 1 / long], 1), (low - mean[best]) ** 2, rcond=None)[0]
            curves.append((mean, *np.maximum(spread, (1e-4, 1e-2)).tolist()))
        self.curves = tuple(curves)

    def noise(self, entropy: np.ndarray, best: np.ndarray, long: np.ndarray) -> np.ndarray:
        """How much likelier texts are among shuffled letters than among texts of their best language, as a logarithm."""
        if self.curves is None:
            return np.full(len(entropy), -np.inf)
        log = []
        for mean, a, b in self.curves:
            var = a + b / long
            log.append(-((entropy - mean[best]) ** 2) / (2 * var) - np.log(var) / 2)
        # Beyond the mean of the shuffled texts nothing is a language, whichever curve is wider.
        beyond = entropy >= self.curves[1][0][best]
        return np.where(entropy <= self.curves[0][0][best], -np.inf, np.where(beyond, np.inf, log[1] - log[0]))

    def judge(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """Language, score, cross-entropy, rejected."""
        e = self.entropies(texts)
        best = e.argmin(1)
        # The posterior of the winner, each character's evidence tempered as if 20 of them told as much as one.
        long = np.array([len(t) for t in texts])
        score = 1 / np.exp(np.clip(-(e - e.min(1, keepdims=True)) * np.maximum(long[:, None] / 20, 1), -60, 0)).sum(1)
        noise = self.noise(e.min(1), best, long) > 0
        return [(self.langs[b], float(s), float(x[b]), bool(r)) for b, s, x, r in zip(best, score, e, noise)]


FOUND = ["lang_pred", "score", "entropy", "rejected"]


def judge_rows(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for pdf in batches:
            texts = [letters_of(t) if t else "" for t in pdf.iloc[:, -1]]
            some = [i for i, t in enumerate(texts) if t]
            out: list = [("und", 0.0, None, True)] * len(texts)
            if some and model.langs:
                for i, x in zip(some, model.judge([texts[i] for i in some])):
                    out[i] = x
            frame = pd.DataFrame(out, columns=FOUND)
            yield pd.concat([pdf.iloc[:, :-1].reset_index(drop=True), frame], axis=1)
        give_back()

    return run


by_value(__name__)


def held_out(id_: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from labelled rows that aren't held out.

    Rows are taken in the order of a hash of the id, by language, until sample_chars characters are fitted and a
    quarter as many held back to calibrate; what is over in the last text is cut off, and no text sends more than
    sample_chars characters to the driver. A language's first text is always fitted, and after it each text is held
    back while those that are have less than a third of what is fitted. Null texts and languages teach nothing.
    """
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.left(text_col, F.lit(sample_chars)).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 30)).alias("h")
    )
    sizes = {r["lang"]: (r["n"], r["most"]) for r in rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n"), F.max(F.char_length("text")).alias("most")).collect()}
    take = F.lit(False)
    for lang, (n, most) in sizes.items():
        # What is asked for is more than what is taken: sampling by a hash varies, and texts lose what is no letter.
        take = take | ((F.col("lang") == lang) & (F.col("h") < int(min(1.0, (2 * sample_chars + most) / max(n, 1)) * (1 << 30))))
    taken: dict = {lang: ([], []) for lang in sizes}
    used = {lang: [0, 0] for lang in sizes}
    room = (sample_chars, sample_chars // 4)
    for r in rows.filter(take).orderBy("h", "text").toLocalIterator():
        n = used[r["lang"]]
        side = int(3 * n[1] < n[0] and n[1] < room[1] or n[0] >= room[0])
        if n[side] < room[side] and (text := letters_of(r["text"])):
            text = text[: room[side] - n[side]]
            taken[r["lang"]][side].append(text)
            n[side] += len(text)
    fitted = {lang: x for lang, (x, _) in taken.items() if x}
    model = Model.fit(fitted) if fitted else Model([], [], np.empty(0))
    if fitted:
        model.calibrate([t for lang in sorted(fitted) for t in taken[lang][1]])
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] = [], text_col: str = "text") -> DataFrame:  # noqa: B006
    """The columns in keep, and lang_pred, score (0 to 1), entropy (nats a character) and rejected.

    A kept column with one of these four names is returned with `_in` after its name. Null text, and text without a
    letter, is `und`, with score 0, a null entropy, and rejected. So is every text if the model has no language.
    Repeated rows stay repeated; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, inner)), F.col(text_col).alias("text"))
    kinds = ", ".join([f"{x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(keep, inner)] + ["lang_pred string", "score double", "entropy double", "rejected boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    return rows.mapInPandas(judge_rows(shared), kinds).toDF(*(f"{c}_in" if c in FOUND else c for c in keep), *FOUND)
