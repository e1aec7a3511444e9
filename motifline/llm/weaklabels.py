"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation
maximisation over the counts of vote patterns estimates how each labeller votes on
good and on bad texts, without any true label, and gives each pattern a posterior.
A linear scorer on hashed byte trigrams is trained on the posteriors of a bounded
sample, and scores every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.llm.common import apart, map_column

GOOD, BAD, NONE = 1, 0, 2
#: Texts that the scorer is trained on, about; those with the smallest hashes of their ids.
SAMPLE = 4_000
WIDTH, STEPS, RIDGE = 2_048, 400, 1e-6
REJECTED_BELOW = 0.4  # in doubt a text stays
FIGURE = 0.25  # weight of a figure's range beside the trigrams, whose squares sum to 1
TEXT_BYTES = 1 << 16  # a long text is counted in slices of so many bytes
# Frequent small words of the corpus' languages.
SMALL_WORDS = set(
    "the of and to in a is that it for was on are as with be by at this an from or la de et les des un une le que qui est en du par pour sur dans pas au avec "
    "el los las y se del por con una no su para al lo der die das und ist von mit den ein eine zu im auf nicht sich auch des für in".split()
)

Labeller = Callable[["Facts"], int]


class Facts:
    """What the labellers look at, from one pass over a whole text."""

    def __init__(self, text: str):
        words = text.split()
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        byte = np.bincount(data, minlength=256)
        self.n = len(words)
        some = max(1, self.n)
        self.signs = int(byte[[ord(c) for c in "*#$%&~^<>{}[]\\"]].sum()) / some
        self.pipes = int(byte[ord("|")] + byte[9]) / some
        self.cries = int(byte[ord("!")] + byte[ord("?")]) / some
        self.capitals = int(byte[65:91].sum()) / max(1, int(byte[65:91].sum() + byte[97:123].sum()))
        self.repeats = sum(map(str.__eq__, words, words[1:])) / some
        self.small = sum(map(SMALL_WORDS.__contains__, words)) / some
        counts = Counter(words)
        self.variety = len(counts) / some
        self.top = max(counts.values(), default=0) / some
        lines = [x for x in text.splitlines() if x]
        self.lines = 1 - len(set(lines)) / max(1, len(lines))
        self.stops = int(byte[ord(".")] + byte[ord("!")] + byte[ord("?")]) / some
        self.letters = 1 - int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()) / max(1, len(data))


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


LABELLERS: dict[str, Labeller] = {
    "signs": lambda f: _vote(f.n >= 10 and f.signs > 0.5, f.n >= 20 and f.signs < 0.05),
    "pipes": lambda f: _vote(f.pipes > 0.3, f.n >= 20 and f.pipes < 0.02),
    "cries": lambda f: _vote(f.n >= 10 and f.cries > 0.5, f.n >= 20 and f.cries < 0.05),
    "capitals": lambda f: _vote(f.n >= 10 and f.capitals > 0.4, f.n >= 20 and f.capitals < 0.12),
    "repeats": lambda f: _vote(f.n >= 10 and f.repeats > 0.2, f.n >= 20 and f.repeats < 0.05),
    "variety": lambda f: _vote(f.n >= 40 and f.variety < 0.15, f.n >= 40 and f.variety > 0.3),
    "top word": lambda f: _vote(f.n >= 20 and f.top > 0.25, f.n >= 40 and f.top < 0.1),
    "lines": lambda f: _vote(f.n >= 40 and f.lines > 0.8, f.n >= 40 and f.lines < 0.3),
    "small words": lambda f: _vote(f.n >= 40 and f.small < 0.02, f.n >= 20 and f.small > 0.1),
    "sentences": lambda f: _vote(f.n >= 200 and f.stops < 0.002, f.n >= 20 and 0.02 < f.stops < 0.4),
    "letters": lambda f: _vote(f.n >= 20 and f.letters < 0.85, f.n >= 20 and f.letters > 0.94),
    "words": lambda f: _vote(f.n == 0, f.n >= 40),
}


def votes_of(text: str | None) -> str:
    facts = Facts(text or "")
    return "".join(str(label(facts)) for label in LABELLERS.values())


@dataclass
class LabelModel:
    """prior[y]: share of class y; rates[l, y, v]: how often labeller l votes v on texts of class y
    if it votes at all. No vote says nothing about the class."""

    prior: np.ndarray
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each line of votes."""
        told = np.concatenate([np.log(self.rates), np.zeros((len(self.rates), 2, 1))], axis=2)
        logs = np.log(self.prior)[None, :] + sum(told[i][:, votes[:, i]].T for i in range(votes.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, BAD] - logs[:, GOOD], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, the share of its votes that are right."""
        right = self.prior[None, :] * np.stack([self.rates[:, BAD, BAD], self.rates[:, GOOD, GOOD]], axis=1)
        given = (self.prior[None, :, None] * self.rates).sum((1, 2))
        return right.sum(1) / np.maximum(given, 1e-12)


def fit_labels(votes: np.ndarray, counts: np.ndarray, steps: int = 100) -> LabelModel:
    """Expectation maximisation over vote patterns and how many texts have each; starts from the majority."""
    weight = counts.astype(float)
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    # A vote for bad says more than one for good: heuristics fire on few texts.
    belief = np.where(bad > 0, np.where(good > 3 * bad, 0.4, 0.05), np.where(good > 0, 0.95, 0.5))
    model = None
    for _ in range(steps):
        share = np.stack([(1 - belief) * weight, belief * weight])
        prior = (share.sum(1) + 1) / (weight.sum() + 2)
        rates = np.stack([[[share[y][votes[:, i] == v].sum() + 0.1 for v in range(2)] for y in range(2)] for i in range(votes.shape[1])])
        rates /= rates.sum(2, keepdims=True)
        model = LabelModel(prior, rates)
        new = model.posterior(votes)
        if np.abs(new - belief).max() < 1e-9:
            break
        belief = new
    return model


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text: square roots of the shares of its byte trigrams, and
    the range in which each of its figures lies."""
    data = np.frombuffer(f"  {text or ''} ".encode(), dtype=np.uint8).astype(np.uint32)
    total = np.zeros(WIDTH)
    for i in range(0, len(data) - 2, TEXT_BYTES):
        d = data[i : i + TEXT_BYTES + 2]
        code = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA6B)) ^ (d[2:] * np.uint32(0xC2B2AE35))
        total += np.bincount((code ^ (code >> np.uint32(15))) % np.uint32(WIDTH), minlength=WIDTH)
    out = np.sqrt(total / max(1.0, total.sum()))
    facts = Facts(text or "")
    for name, value in vars(facts).items():
        step = int(8 * min(value, 1.5)) if name != "n" else value.bit_length()
        out[crc32(f"{name}:{step}".encode()) % WIDTH] += FIGURE
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))


def fit_scorer(x: np.ndarray, belief: np.ndarray) -> Scorer:
    """Logistic regression on posteriors by accelerated gradient steps."""
    x, y = x.astype(np.float32), belief.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    ahead, ahead_b = w, b
    # The curvature is at most a quarter of the largest squared length, with the bias.
    rate = np.float32(4 / (1 + (x**2).sum(1).max()))
    for step in range(STEPS):
        error = (1 / (1 + np.exp(-(x @ ahead + ahead_b))) - y) / np.float32(len(x))
        new, new_b = ahead - rate * (x.T @ error + np.float32(RIDGE) * ahead), ahead_b - rate * error.sum()
        momentum = np.float32(step / (step + 3))
        ahead, ahead_b = new + momentum * (new - w), new_b + momentum * (new_b - b)
        w, b = new, new_b
    return Scorer(w.astype(float), float(b))


@dataclass
class Classifier:
    labels: LabelModel
    scorer: Scorer

    def judge(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """The columns `keep`, score (probability of good) and quality (1 good, 0 bad) of each whole text."""
        scorer = self.scorer

        def make():
            def one(t):
                score = float(scorer(features(t))) if t and not t.isspace() else 0.0
                return round(score, 6), int(score >= REJECTED_BELOW)

            return one

        return map_column(docs, keep, text, make, "_score double, _quality int")


def fit(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> Classifier | None:
    """Label model over all texts, scorer over a sample; None for an empty table.

    Only vote patterns (at most 3 ** labellers) and the sample's features reach the driver.
    """
    one_vote = lambda: lambda t: (votes_of(t),)
    patterns = map_column(docs, [], text, one_vote, "votes string").groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not patterns:
        return None
    as_array = lambda rows: np.array([[int(c) for c in r.votes] for r in rows])
    model = fit_labels(as_array(patterns), np.array([r.n for r in patterns]))
    share = sample / sum(r.n for r in patterns)
    order = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", text), F.lit(1 << 40))
    drawn = docs.select(order.alias("_order"), F.col(text).alias("_text")).where(F.col("_order") < int(min(1.0, share) * (1 << 40)))

    def make():
        return lambda t: (votes_of(t), features(t).astype(np.float32).tobytes())

    rows = map_column(drawn, ["_order"], "_text", make, "votes string, x binary").orderBy("_order", "votes").collect()
    if not rows:
        return Classifier(model, Scorer(np.zeros(WIDTH), 0.0))
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in rows])
    return Classifier(model, fit_scorer(x, model.posterior(as_array(rows))))


def judged(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, quality per document. A null or blank text is bad with score 0; repeated rows are judged alike."""
    made = fit(docs, sample)
    if made is None:
        return docs.selectExpr("doc_id", "cast(0 as double) as score", "0 as quality")
    return made.judge(docs, ["doc_id"]).toDF("doc_id", "score", "quality")


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows judged good, with the columns of `docs`.

    A null or blank text is bad, rows of equal texts are judged alike, and null ids pass
    like others. Other columns pass, whatever their names. An empty table stays empty.
    """

    def run(docs: DataFrame) -> DataFrame:
        made = fit(docs, sample)
        if made is None:
            return docs
        whole = docs.withColumn("_judged", F.col("text"))
        return made.judge(whole, docs.columns, "_judged").where("_quality = 1").select(*docs.columns)

    return apart(docs, ("doc_id", "text"), run)
