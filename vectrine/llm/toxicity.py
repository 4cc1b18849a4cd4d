"""Toxicity by weak supervision.

Voters are fixed lexicons and patterns of four languages, lexicons of words and word stems whose presence marks toxic rows of the
learnable sample, and measures of density.  A generative label model (expectation maximisation over voters that hit, pass or abstain, each of
which may depend on one other) estimates their accuracies and correlations.  Its posteriors are the labels on which a linear
classifier over the same evidence is trained; gold labels choose the lexicons and the prior only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.llm.common import id_crc, materialise, read
from vectrine.llm.learn import labelled, logistic

TRAIN_ROWS = 12_000
STEM_LENGTHS = (4, 5, 6)
LEXICON_SIZE = 400
WORD_PARTS, STEM_PARTS = 4, 3
#: Lexicons by language and kind; each is a voter.
LEXICONS = {
    "en insults": "idiot idiots moron morons stupid imbecile dumb dumbass fool loser losers clown clowns coward cretin halfwit jerk",
    "en contempt": "pathetic disgusting worthless disgrace ugly despicable repulsive useless revolting contemptible laughable",
    "en dehumanising": "scum vermin filth filthy trash garbage parasite parasites subhuman cockroach cockroaches maggot maggots",
    "en profanity": "crap bastard bastards damn bitch shit shitty asshole fuck fucking bullshit whore slut prick",
    "en hostility": "hate hateful despise loathe exterminate bloodthirsty deserves",
    "de insults": "idiot idioten dummkopf trottel depp vollidiot versager schwachkopf volltrottel blödmann feigling",
    "de profanity": "scheiße scheiss arschloch verdammt hure hurensohn wichser drecksau fotze",
    "de contempt": "abschaum ungeziefer dreck müll widerlich erbärmlich wertlos ekelhaft abartig",
    "fr insults": "idiot idiots idiote imbécile crétin abruti débile bouffon minable connard connasse",
    "fr profanity": "merde putain salope enculé bâtard foutre salaud",
    "fr contempt": "ordure déchet vermine dégoûtant pathétique répugnant méprisable racaille",
    "es insults": "idiota idiotas imbécil estúpido estúpida tonto cretino payaso inútil cobarde",
    "es profanity": "mierda puta puto cabrón joder gilipollas pendejo coño",
    "es contempt": "basura escoria asqueroso patético repugnante despreciable gentuza",
}
#: Patterns by language and kind; each is a voter.
PATTERNS = {
    "en attack": r"\b(?:you|he|she|they|these|those|this|such|what)(?: are| is|'re)?(?: an?| the)?(?: \w+)? (?:idiot|moron|scum|trash|loser|clown|stupid|pathetic|disgusting|worthless|garbage|vermin)",
    "en threat": r"\b(?:i|we)(?:'ll| will| am going to| are going to) (?:kill|hurt|destroy|find) (?:you|them|him|her)|\b(?:go|should|must|please) (?:die|rot)\b|\bkill yourself\b",
    "en dismissal": r"\bshut (?:the \w+ )?up\b|\bget lost\b|\bgo to hell\b|\bscrew you\b|\bhate (?:you|them|those|these)\b",
    "de attack": r"\b(?:du|ihr|sie|diese|dieser|so ein|was für ein)(?: bist| seid| sind| ist)?(?: eine?)? (?:idiot|trottel|depp|versager|dummkopf|abschaum|dreck|arschloch)",
    "de threat": r"\b(?:ich|wir) (?:werde|werden|bringe|bringen|mache|machen) (?:dich|euch|sie) (?:um|fertig|kaputt|töten)|\bhalt(?:et)? (?:die klappe|das maul|die fresse)\b",
    "fr attack": r"\b(?:tu|vous|il|elle|ils|elles|ce|cette|quel|espèce)(?: es| êtes| est| sont|tes)?(?: un| une| des| d')? ?(?:idiot|imbécile|crétin|abruti|connard|ordure|déchet|minable)",
    "fr threat": r"\b(?:je|nous|on) (?:vais|allons|va) (?:te|vous|les) (?:tuer|détruire|frapper)|\b(?:ta|fermez vos?) gueules?\b|\bva (?:mourir|crever|te faire)\b",
    "es attack": r"\b(?:tú|usted|ustedes|él|ella|ellos|eres|son|es|este|esta|qué)(?: eres| son| es)?(?: una?)? (?:idiota|imbécil|estúpid[oa]|cretino|basura|escoria|payaso|inútil)",
    "es threat": r"\b(?:te|los|las|les) (?:voy|vamos) a (?:matar|destruir|golpear)|\bcállate\b|\bvete a la\b|\bmuérete\b",
}
_COMPILED = {name: re.compile(pattern) for name, pattern in PATTERNS.items()}
#: How a word begins that stands in every text that a pattern fits; a pattern is tried on no other text.
TRIGGERS = {
    "en attack": "idiot moron scum trash loser clown stupid pathetic disgusting worthless garbage vermin",
    "en threat": "kill hurt destroy find should must please go",
    "en dismissal": "shut lost hell screw hate",
    "de attack": "idiot trottel depp versager dummkopf abschaum dreck arschloch",
    "de threat": "bringe mache werde klappe maul fresse",
    "fr attack": "idiot imbécile crétin abruti connard ordure déchet minable",
    "fr threat": "vais allons tuer gueule mourir crever faire",
    "es attack": "idiota imbécil estúpid cretino basura escoria payaso inútil",
    "es threat": "matar destruir golpear cállate vete muérete",
}
_BEGINNINGS = {name: tuple(words.split()) for name, words in TRIGGERS.items()}
_WORD = re.compile(r"[^\W\d_]+")
LEARNED = tuple(f"{kind} words, part {k}" for kind in ("pure", "mixed") for k in range(WORD_PARTS)) + tuple(
    f"stems of {n}, part {k}" for n in STEM_LENGTHS for k in range(STEM_PARTS)
)
VOTERS = (*LEXICONS, *PATTERNS, *LEARNED, "several marks", "dense evidence", "no evidence")
_AT = {name: k for k, name in enumerate(VOTERS)}
COUNTED = len(LEXICONS) + len(PATTERNS) + len(LEARNED)
#: of a text: hits of each voter that counts, then marked words, their share, and distinct marked words
EVIDENCE = COUNTED + 3


def part_of(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts


@dataclass
class Lexicons:
    """Words and stems learned from labels, beside the fixed lexicons; pure words were in toxic rows only."""

    pure: frozenset[str] = frozenset()
    mixed: frozenset[str] = frozenset()
    stems: dict[int, frozenset[str]] = field(default_factory=dict)

    def voters(self, word: str) -> tuple[int, ...]:
        """The voters that a word is a hit of."""
        found = [_AT[name] for name, held in _FIXED.items() if word in held]
        found += [
            _AT[f"{kind} words, part {part_of(word, WORD_PARTS)}"] for kind,
            held in (("pure", self.pure), ("mixed", self.mixed)) if word in held
        ]
        if len(word) >= 5:
            found += [
                _AT[f"stems of {n}, part {part_of(word[:n], STEM_PARTS)}"] for n,
                held in self.stems.items() if len(word) > n and word[:n] in held
            ]
        return tuple(found)

    def evidence(self, text: str, known: _Known | None = None) -> list[float]:
        lower = text.lower()
        words = _WORD.findall(lower)
        kinds = set(words)
        known = _Known(self) if known is None else known
        out = [0.0] * EVIDENCE
        marked, tried = set(), set()
        # few words begin as a word that counts does
        starts = known.starts
        for w in [w for w in kinds if w[:3] in starts]:
            found = known[w]
            if found:
                voters, patterns = found
                tried.update(patterns)
                if voters:
                    marked.add(w)
                    for k in voters:
                        out[k] += 1
        for name in tried:
            if _COMPILED[name].search(lower):
                out[_AT[name]] = 1.0
        hits = sum(map(marked.__contains__, words)) if marked else 0
        out[COUNTED:] = [hits, hits / max(1, len(words)), len(marked)]
        return out


class _Known(dict):
    """Of words: their voters, and the patterns that they are a reason to try; None of most.  Kept while there are at most ``LIMIT``."""

    LIMIT = 300_000

    def __init__(self, lexicons: Lexicons):
        super().__init__()
        self.lexicons = lexicons
        counting = [*_FIXED.values(), lexicons.pure, lexicons.mixed, *lexicons.stems.values(), *_BEGINNINGS.values()]
        self.starts = frozenset(word[:3] for words in counting for word in words)

    def __missing__(self, word: str) -> tuple[tuple[int, ...], tuple[str, ...]] | None:
        if len(self) >= self.LIMIT:
            self.clear()
        voters = self.lexicons.voters(word)
        patterns = tuple(name for name, beginnings in _BEGINNINGS.items() if word.startswith(beginnings))
        self[word] = found = (voters, patterns) if voters or patterns else None
        return found


_FIXED = {name: frozenset(words.split()) for name, words in LEXICONS.items()}


def votes(e: np.ndarray) -> np.ndarray:
    """1 toxic, 0 not, -1 abstains; a column for each of VOTERS."""
    density, marked = e[:, COUNTED + 1], e[:, COUNTED + 2]
    direct = np.where(e[:, :COUNTED] > 0, 1, -1)
    stems = slice(COUNTED - len(STEM_LENGTHS) * STEM_PARTS - WORD_PARTS, COUNTED)
    # a mixed word or a stem is met by chance; one alone is no sign
    direct[:, stems] = np.where(e[:, stems] > 1, 1, np.where(e[:, stems] > 0, 0, -1))
    several = np.where(marked >= 3, 1, np.where(marked == 1, 0, -1))
    dense = np.where((marked >= 2) & (density > 0.01), 1, np.where(density < 0.0005, 0, -1))
    return np.column_stack([direct, several, dense, np.where(marked == 0, 0, -1)])


def dependence(one_hot: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters given the class, by the posteriors ``p``."""
    n, m, _ = one_hot.shape
    flat = one_hot.reshape(n, m * 3)
    total = np.zeros((m, m))
    for q in (1 - p, p):
        joint = (flat * q[:, None]).T @ flat / n
        single = np.diag(joint)
        share = max(q.mean(), 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = joint * np.log(joint * share / np.outer(single, single))
        total += np.where(joint > 1e-12, part, 0).reshape(m, 3, m, 3).sum(axis=(1, 3))
    return total


def forest(weight: np.ndarray, least: float) -> list[int]:
    """The parent of each voter in a maximum spanning forest of the pairs above ``least``; -1 for a root."""
    m = len(weight)
    parent, held = [-1] * m, np.zeros(m, bool)
    best, source = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):
        k = int(np.argmax(np.where(held, -np.inf, np.where(np.isneginf(best), -1e300, best))))
        parent[k] = int(source[k]) if best[k] > least else -1
        held[k] = True
        closer = ~held & (weight[k] > best)
        best[closer], source[closer] = weight[k][closer], k
    return parent


def label_model(v: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of class 1, accuracies of the voters, and their correlations given the class.

    The generative model is a class and, given it, a forest of voters: P(vote | parent's vote, class), estimated by expectation maximisation
    from the votes' own direction.  The forest joins the voters that tell most about each other given the class, so
    one that repeats another adds nothing to it.
    """
    n, m = v.shape
    one_hot = np.stack([v == -1, v == 0, v == 1], axis=2).astype(float)
    state = v + 1
    start = np.where(v == 1, 1.0, np.where(v == 0, -1.0, 0.0)).sum(axis=1) + math.log(prior / (1 - prior)) / 2
    p = 1 / (1 + np.exp(-np.clip(start, -30, 30)))
    parent = [-1] * m
    for k in range(rounds):
        if k in (3, 10):
            parent = forest(dependence(one_hot, p), math.log(max(n, 2)) / max(n, 1))
        log_odds = np.zeros(n)
        for i in range(m):
            tables = []
            for q in (1 - p, p):
                own = (one_hot[:, i] * q[:, None]).sum(axis=0) + 0.5
                table = np.tile(own / own.sum(), (3, 1))
                if parent[i] >= 0:
                    # smoothed towards what the class alone says
                    seen = one_hot[:, parent[i]].T @ (one_hot[:, i] * q[:, None])
                    table = (seen + 2 * table) / (seen.sum(axis=1, keepdims=True) + 2)
                tables.append(np.log(table))
            at = state[:, parent[i]] if parent[i] >= 0 else np.zeros(n, int)
            log_odds += (tables[1] - tables[0])[at, state[:, i]]
        rate = min(max(float(p.mean()), prior / 2), min(0.5, prior * 2))
        p = 1 / (1 + np.exp(-np.clip(log_odds + math.log(rate / (1 - rate)), -30, 30)))
    by_class = [((one_hot * q[:, None, None]).sum(axis=0) + 0.5) / (q.sum() + 1.5) for q in (1 - p, p)]
    expected = [c[:, 2] - c[:, 1] for c in by_class]
    centred = one_hot[:, :, 2] - one_hot[:, :, 1] - ((1 - p)[:, None] * expected[0] + p[:, None] * expected[1])
    spread = np.maximum(centred.std(axis=0), 1e-9)
    correlation = (centred.T @ centred) / n / np.outer(spread, spread)
    told = v >= 0
    agrees = np.where(v == 1, p[:, None], 1 - p[:, None])
    accuracy = np.where(told.any(axis=0), (agrees * told).sum(axis=0) / np.maximum(told.sum(axis=0), 1), np.nan)
    return p, accuracy, correlation


@dataclass
class Model:
    lexicons: Lexicons
    weights: np.ndarray
    intercept: float
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None

    def scores(self, e: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(e) @ self.weights + self.intercept, -30, 30)))


def inputs(e: np.ndarray) -> np.ndarray:
    """What the classifier sees of the evidence."""
    density = e[:, COUNTED + 1 : COUNTED + 2]
    return np.hstack([np.log1p(e[:, : COUNTED + 1]), np.minimum(density * 20, 3), np.log1p(e[:, COUNTED + 2 :])])


def _candidates(text: str) -> set[str]:
    """Words as they are, stems as length and text."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{k}:{w[:k]}" for w in words for k in STEM_LENGTHS if len(w) > k}


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hash of three consecutive words, which near copies mostly share."""
    for batch in batches:
        marks = []
        for text in batch.column(0).to_pylist():
            words = text.lower().split()
            marks.append(min(xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], ["text", "y", "mark"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other rows of the partition hold each candidate."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if y else other).update(_candidates(text))
    rows = [(c, toxic.get(c, 0), other.get(c, 0)) for c in toxic.keys() | other.keys()]
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in part], pa.string()),
                pa.array([r[1] for r in part], pa.int64()),
                pa.array([r[2] for r in part], pa.int64())
            ],
            ["candidate", "toxic", "other"]
        )


def _evidence(lexicons: Lexicons) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(lexicons)
        for batch in batches:
            rows = [lexicons.evidence(text, known) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["e", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, learnable: Callable, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents; with no toxic or no other row among them, only the fixed lexicon counts."""
    # of exact and most near copies one stays, the one with the smallest hash, lest their common words pass for evidence; read three times
    sample = labelled(docs, labels, "toxic", learnable, rows).mapInArrow(_fingerprint, "text string, y int, mark long")
    sample = sample.groupBy("mark", "y").agg(F.min(F.struct(F.xxhash64("text").alias("drawn"), "text")).alias("first"))
    sample = materialise(sample.select("first.text", "y"), "toxic-sample")
    size = sample.agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
    n1, n0 = size["toxic"] or 0, size["rows"] - (size["toxic"] or 0)
    if not n1 or not n0:
        weights = np.zeros(inputs(np.zeros((1, EVIDENCE))).shape[1])
        weights[: len(LEXICONS)] = 3.0
        return Model(Lexicons(), weights, -2.0)
    share = n1 / (n1 + n0)
    counted = sample.mapInArrow(_count, "candidate string, toxic long, other long").groupBy("candidate").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    ).where("toxic >= 2")
    counted = materialise(counted, "candidates")
    held = F.col("toxic") + F.col("other")
    # the log of how unlikely the split is by chance; it has to beat the number of candidates
    gain = F.col("toxic") * F.log(F.col("toxic") / held / share) + F.col("other") * F.log(
        F.greatest(F.col("other"), F.lit(0.5)) / held / (1 - share)
    )
    ratio = F.col("toxic") / n1 / ((F.col("other") + 0.5) / n0)
    best = counted.where(
        (gain > math.log(max(1, counted.count())) + 2) & (ratio >= 8)
    ).orderBy(F.desc(gain), "candidate").limit(LEXICON_SIZE).collect()
    pure, mixed = (
        frozenset(r["candidate"] for r in best if ":" not in r["candidate"] and (r["other"] == 0) == only) for only in (True, False)
    )
    # a stem that one word stands for says nothing new, and fits other languages by chance
    def alone(stem: str, toxic: int) -> bool:
        return any(r["toxic"] >= 0.8 * toxic for r in best if r["candidate"].startswith(stem))

    stems = {
        k: frozenset(
            r["candidate"][2:] for r in best if r["candidate"].startswith(f"{k}:") and not alone(r["candidate"][2:], r["toxic"])
        ) for k in STEM_LENGTHS
    }
    lexicons = Lexicons(pure, mixed, stems)
    seen = sample.mapInArrow(_evidence(lexicons), "e array<double>, y int").collect()
    seen.sort(key=lambda r: (r["y"], r["e"]))
    e = np.array([r["e"] for r in seen], float)
    p, accuracies, correlations = label_model(votes(e), share)
    weights, intercept = logistic(inputs(e), p, ridge=0.1 * len(e) ** 0.5)
    return Model(lexicons, weights, intercept, accuracies, correlations)


def rate(docs: DataFrame, model: Model, held) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; no shuffle.

    Null and empty texts are scored as texts with no evidence.  Null ids, ties and repeated rows pass through row by row; very
    long texts are read whole; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model.lexicons)
        for batch in batches:
            e = np.array([model.lexicons.evidence(text.as_py() or "", known) for text in batch.column(2)], float).reshape(
                len(batch), EVIDENCE
            )
            score = model.scores(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def held_out(doc_id):
    return F.pmod(id_crc(doc_id), F.lit(5)) == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return rate(docs, model, held_out(F.col("doc_id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
