"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause: insults and threats mark a word at its arc's weight; negations and
reported speech stay in force for a few words and tag what is marked meanwhile; the target transducer says
whether the clause names whom it is about, before or after. They are tables of arcs (``TRANSDUCERS``), and ``compose``
makes one automaton of them, whose outputs are patterns: an insult or a threat, bare, aimed, negated
or reported. A clause pays for its matched patterns, and a document is judged by its clauses: their
sum per length, the strongest one, how many match, and how much each kind of pattern paid.

Words become symbols by lexicons: seeds in four languages and arcs learned from labelled documents. Insults
are words and beginnings of words (inflected forms share them) that are significantly likelier in toxic documents;
threats are those that are so only in clauses with a target; negations and reports are words before an insult
that are significantly likelier in clean documents, and targets words that toxic documents prefer in clauses with an insult.
Lexicons and the logistic weights of the patterns are fitted on at most ``FIT_ROWS`` labelled rows, picked by a hash of their ids.

Defined results: a null or empty text has no clause and gets the score of a text without matches; rows that
repeat an id are scored each; without labels of both kinds the seed grammar is used with a fixed
calibration. Only the text enters a score. Further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.frames import crc_bucket, materialize

# Seed lexicons, by language.
INSULTS = tuple(
    "clown disgusting dumb idiot imbecile loser moron pathetic scum stupid trash worthless "
    "abschaum dummkopf idiotin schwachkopf trottel versager widerlich wertlos "
    "abruti crétin déchet imbécile minable ordure "
    "basura escoria estúpida estúpido idiota imbécil inútil payaso".split()
)
THREATS = tuple(
    "beat destroy hurt kill punch stab strangle "
    "erstechen erwürgen töten umbringen verletzen verprügeln "
    "détruire étrangler frapper poignarder tuer tuerai "
    "apuñalar destruir estrangular golpear matar mataré".split()
)
TARGETS = tuple("you your yours you're he she they them him her u du dich dir dein ihn ihm euch tu toi vous lui eux usted ustedes él ella ti".split())
NEGATIONS = tuple("not no never isn't aren't don't wasn't nicht kein keine nie pas jamais aucun nunca jamás ningún".split())
REPORTS = tuple("said says say wrote called quoted claims reported sagte schrieb nannte zitierte dit écrit appelé cité dijo escribió llamó citó".split())

#: Words for which a negation or a report stays in force.
NEGATION_REACH, REPORT_REACH = 3, 6
#: What a pattern is worth of its arc's weight before anything is learned, and the weight of seeds.
AIMED, NEGATED, REPORTED, BARE_THREAT = 1.25, 0.3, 0.7, 0.05
SEED_WEIGHT = 3.0
#: Bound: labelled rows for lexicons and calibration.
FIT_ROWS = 20_000
#: A learned arc is found in so many documents at least, its log odds are so large, and the deviance of its counts is more than
#: chance gives the best of all terms that were tested (twice the logarithm of their number) by a margin: none for insults;
#: the other arcs change what an insult is worth and need more.
LEAST_DOCUMENTS = 3
LEAST_LOG_ODDS = 1.5
INSULT_MARGIN, OTHER_MARGIN = 0.0, 10.0
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

_CLAUSE = re.compile(r"[.!?;:\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: The symbols of the composed automaton; every word in no lexicon is the last one.
SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")


@dataclass(frozen=True)
class Transducer:
    """Arcs by (state, symbol); other symbols follow ``rest``. A state in ``tags`` tags what is marked in it, ``marks`` mark."""

    arcs: dict[tuple[int, str], int] = field(default_factory=dict)
    rest: dict[int, int] = field(default_factory=lambda: {0: 0})
    marks: tuple[str, ...] = ()
    tag: str = ""


def _in_force(symbol: str, reach: int, tag: str) -> Transducer:
    """For ``reach`` words after the symbol, what is marked gets the tag."""
    return Transducer({(s, symbol): reach for s in range(reach + 1)}, {s: max(s - 1, 0) for s in range(reach + 1)}, (), tag)


TRANSDUCERS = {
    "insult": Transducer(marks=("insult",)),
    "threat": Transducer(marks=("threat",)),
    "target": Transducer({(0, "target"): 1}, {0: 0, 1: 1}, (), "aimed"),
    "negation": _in_force("negation", NEGATION_REACH, "negated"),
    "report": _in_force("report", REPORT_REACH, "reported"),
}


@dataclass(frozen=True)
class Automaton:
    """The composition: by state, the next state for each symbol, what a mark is tagged with, and whether the clause is aimed."""

    step: list[list[int]]
    tags: list[frozenset[str]]
    marks: frozenset[str]
    aimed: list[bool]


def compose(parts: dict[str, Transducer]) -> Automaton:
    """The product of the transducers; a state is one state of each, numbered as they are reached from the start."""
    order = list(parts.values())
    number = {tuple(0 for _ in order): 0}
    todo, step = list(number), []
    for state in todo:
        row = []
        for symbol in SYMBOLS:
            after = tuple(t.arcs.get((s, symbol), t.rest[s]) for t, s in zip(order, state, strict=True))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        step.append(row)
    tags = [frozenset(t.tag for t, s in zip(order, state, strict=True) if s and t.tag) for state in todo]
    return Automaton(step, [t - {"aimed"} for t in tags], frozenset(m for t in order for m in t.marks), ["aimed" in t for t in tags])


#: Kinds of patterns, each with its own weight; what is negated or reported counts as that, aimed or not.
PATTERNS = tuple((kind, how) for kind in ("insult", "threat") for how in ("bare", "aimed", "negated", "reported"))
N_FEATURES = 5 + len(PATTERNS)


@dataclass(frozen=True)
class Grammar:
    """Arcs of words (symbol, weight), weights of insults' beginnings, and the logistic calibration of the features."""

    words: dict[str, tuple[str, float]] = field(
        default_factory=lambda: {w: (symbol, SEED_WEIGHT) for symbol, seeds in zip(SYMBOLS, (INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS), strict=False) for w in seeds}
    )
    prefixes: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-2.5, 1.0, 0.0, 0.5, 0.5, 0.0) + (0.0,) * len(PATTERNS)


class ClauseAutomaton:
    """The composed grammar at work; ``without`` names transducers that are left out."""

    def __init__(self, grammar: Grammar, without: tuple[str, ...] = ()):
        self.words, self.prefixes = grammar.words, grammar.prefixes
        self.lengths = tuple(sorted({len(p) for p in self.prefixes}, reverse=True))
        self.machine = compose({name: t for name, t in TRANSDUCERS.items() if name not in without})
        self.memo: dict[str, tuple[int, float] | None] = {}
        other = SYMBOLS.index("other")
        self.idle = []  # by number of other words in a row: the state after them
        row = list(range(len(self.machine.step)))
        for _ in range(max(NEGATION_REACH, REPORT_REACH) + 1):
            self.idle.append(row)
            row = [self.machine.step[s][other] for s in row]

    def arc(self, word: str) -> tuple[int, float] | None:
        """The input symbol that a word is for the grammar, and its weight; None for words outside every lexicon."""
        try:
            return self.memo[word]
        except KeyError:
            found = self.words.get(word)
            if found is None:
                weight = next((self.prefixes[word[:n]] for n in self.lengths if len(word) >= n and word[:n] in self.prefixes), 0.0)
                found = ("insult", weight) if weight else None
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = found = (SYMBOLS.index(found[0]), found[1]) if found else None
            return found

    def patterns(self, words: list[str]) -> list[tuple[int, float, float]]:
        """The matched patterns of a clause: number in ``PATTERNS``, weight, and worth by the prior factors."""
        machine, state, last, marked = self.machine, 0, -1, []
        for place, found in enumerate(map(self.arc, words)):
            if found is None:
                continue
            symbol, weight = found
            state, last = self.idle[min(place - last - 1, len(self.idle) - 1)][state], place
            if SYMBOLS[symbol] in machine.marks:
                marked.append((symbol, weight, machine.tags[state]))
            state = machine.step[state][symbol]
        out = []
        for symbol, weight, tags in marked:
            worth = weight * (NEGATED if "negated" in tags else 1.0) * (REPORTED if "reported" in tags else 1.0)
            aimed = machine.aimed[state]
            worth *= (AIMED if aimed else 1.0) if symbol == 0 else (1.0 if aimed and "negated" not in tags else BARE_THREAT)
            how = 2 if "negated" in tags else 3 if "reported" in tags else int(aimed)
            out.append((4 * symbol + how, weight, worth))
        return out

    def clause(self, text: str) -> tuple[float, int]:
        """What the patterns of one clause pay by the prior factors, and how many matched (a threat matches when it is aimed)."""
        found = self.patterns(_WORD.findall(text.lower()))
        return sum(x[2] for x in found), sum(x[0] < 4 or x[0] in (5, 7) for x in found)

    def features(self, text: str | None) -> tuple[float, ...]:
        """Summed pay, pay per hundred words (both damped), the strongest clause, matched clauses, a match at all, then each pattern's damped sum."""
        total = best = 0.0
        hits = words_seen = 0
        sums = [0.0] * len(PATTERNS)
        for clause in _CLAUSE.split((text or "").lower()):
            words = _WORD.findall(clause)
            words_seen += len(words)
            found = self.patterns(words)
            if found:
                paid = 0.0
                for pattern, weight, worth in found:
                    sums[pattern] += weight
                    paid += worth
                total, best, hits = total + paid, max(best, paid), hits + (paid > 1.0)
        return (float(np.log1p(total)), float(np.log1p(100 * total / (words_seen + 20))), min(best, 6.0), float(np.log1p(hits)), float(hits > 0), *np.log1p(sums).tolist())


def probability(coefficients: tuple[float, ...], features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + features @ np.array(coefficients[1:]), -30, 30)))


def _counted(parts: Iterator[tuple[int, set[tuple[str, int]]]]) -> pa.RecordBatch:
    """(label, what a document holds) of documents -> term, slot, label and number of documents."""
    counts = {0: Counter(), 1: Counter()}
    for label, found in parts:
        counts[label].update(found)
    return _rows((term, slot, label, n) for label, of in counts.items() for (term, slot), n in of.items())


def _rows(found: Iterator[tuple[str, int, int, int]]) -> pa.RecordBatch:
    rows = list(found)
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["term", "slot", "toxic", "n"])


_TERM_ROWS = "term string, slot int, toxic int, n long"


def _by_documents(look):
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = look()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                run = batch.slice(begin, 500)
                yield _counted((label, see((text or "").lower())) for text, label in zip(run.column("text").to_pylist(), run.column("toxic").to_pylist(), strict=True))

    return terms


def _lexical():
    """Words and beginnings of words (slot 0), and words of clauses with a seed target (slot 1)."""
    targets = set(TARGETS)

    def see(text: str) -> set[tuple[str, int]]:
        out = set()
        for clause in _CLAUSE.split(text):
            words = set(_WORD.findall(clause))
            out.update((w, 0) for w in words if len(w) > 2)
            out.update((w[:n] + "*", 0) for w in words for n in PREFIXES if len(w) > n)
            if not targets.isdisjoint(words):
                out.update((w, 1) for w in words if len(w) > 2)
        return out

    return see


def _before_insults(grammar: Grammar):
    """Words up to three (slot 0) and six words (slot 1) before an insult, and one empty term if there is an insult."""

    def look():
        automaton = ClauseAutomaton(grammar)

        def see(text: str) -> set[tuple[str, int]]:
            out = set()
            for clause in _CLAUSE.split(text):
                words = _WORD.findall(clause)
                arcs = list(map(automaton.arc, words))
                for i in (i for i, a in enumerate(arcs) if a and a[0] == 0):
                    out.add(("", 0))
                    out.update((words[k], int(i - k > NEGATION_REACH)) for k in range(max(0, i - REPORT_REACH), i) if arcs[k] is None)
            return out

        return see

    return look


def _with_insults(grammar: Grammar):
    """Words in lexicons' gaps of clauses with an insult (toxic 1) and without (toxic 0), of toxic documents, with their counts."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ClauseAutomaton(grammar)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                run, counts = batch.slice(begin, 500), (Counter(), Counter())
                for text, label in zip(run.column("text").to_pylist(), run.column("toxic").to_pylist(), strict=True):
                    for clause in _CLAUSE.split((text or "").lower()) if label else ():
                        words = _WORD.findall(clause)
                        arcs = list(map(automaton.arc, words))
                        counts[any(a and a[0] == 0 for a in arcs)].update(w for w, a in zip(words, arcs, strict=True) if a is None)
                yield _rows((term, 0, label, n) for label, of in enumerate(counts) for term, n in of.items())

    return look


def _sums(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term", "slot").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c"))


def _arcs(sums: DataFrame, toxic: int, clean: int, sign: int, margin: float) -> list:
    """Terms that are significantly likelier on one side (``sign``): term, slot and log odds."""
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    n, share = F.col("t") + F.col("c"), toxic / (toxic + clean) if toxic else 0.5
    deviance = 2 * (F.col("t") * F.log(F.greatest("t", F.lit(1)) / (n * share)) + F.col("c") * F.log(F.greatest("c", F.lit(1)) / (n * (1 - share))))
    tested = sums.where(F.col("t" if sign > 0 else "c") >= LEAST_DOCUMENTS)
    least = 2 * np.log(max(tested.count(), 1)) + margin
    found = tested.withColumn("odds", odds).where((sign * F.col("odds") >= LEAST_LOG_ODDS) & (deviance >= float(least)))
    return found.select("term", "slot", "odds").collect()  # terms of at most ``FIT_ROWS`` documents


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; steps are halved until they improve the fit."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.array([1e-3] + [ridge] * (x.shape[1] - 1))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * penalty @ w**2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size, then = 1.0, loss(w + step)
        while then > now and size > 1e-6:
            size /= 2
            then = loss(w + size * step)
        if now - then < 1e-9 * max(now, 1.0):
            break
        w, now = w + size * step, then
    return tuple(w.tolist())


def learn_arcs(rows: DataFrame, sizes: dict[int, int]) -> Grammar:
    """The seed grammar with the arcs that labelled ``rows`` (text, toxic) add."""
    seeds = Grammar().words
    sums = materialize(_sums(rows.mapInArrow(_by_documents(_lexical), _TERM_ROWS)))
    plain = {r["term"]: min(r["odds"], 6.0) for r in _arcs(sums.where("slot = 0"), sizes[1], sizes[0], 1, INSULT_MARGIN)}
    aimed = {r["term"]: min(r["odds"], 6.0) for r in _arcs(sums.where("slot = 1"), sizes[1], sizes[0], 1, OTHER_MARGIN)}
    prefixes = {w[:-1]: odds for w, odds in plain.items() if w[-1] == "*"}
    beginnings = {w: any(w[:n] in prefixes for n in PREFIXES) for w in aimed}
    words = {w: ("threat", odds) for w, odds in aimed.items() if w not in plain and not beginnings[w]}
    seen = [plain[w] for w in INSULTS if w in plain]
    typical = float(np.median(seen)) if seen else SEED_WEIGHT  # what seeds that the sample hardly has are worth beside learned weights
    words |= {w: (symbol, typical) for w, (symbol, _) in seeds.items()} | {w: ("insult", odds) for w, odds in plain.items() if w[-1] != "*" and seeds.get(w, ("insult",))[0] == "insult"}
    grammar = Grammar(words, prefixes)

    learned: dict[str, tuple[str, float]] = {}
    before = materialize(_sums(rows.mapInArrow(_by_documents(_before_insults(grammar)), _TERM_ROWS)))
    held = before.where("term = ''").first()
    if held:
        for r in sorted(_arcs(before.where("term <> ''"), held["t"], held["c"], -1, OTHER_MARGIN), key=lambda r: -r["slot"]):
            learned[r["term"]] = (("negation", "report")[r["slot"]], SEED_WEIGHT)
    beside = materialize(_sums(rows.mapInArrow(_with_insults(grammar), _TERM_ROWS)))
    inside, outside = beside.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    learned = {r["term"]: ("target", SEED_WEIGHT) for r in _arcs(beside, inside, outside, 1, OTHER_MARGIN)} | learned
    return Grammar(learned | words, prefixes)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The logistic weights; a threat's pattern that the sample hardly has is worth what the insult's pattern of its kind is."""
    fitted = list(_fit_logistic(x, y))
    first, kinds = 6, len(PATTERNS) // 2  # after the constant and the five summary features
    for k in range(kinds):
        if (x[:, first - 1 + kinds + k] > 0).sum() < LEAST_DOCUMENTS:
            fitted[first + kinds + k] = fitted[first + k]
    return tuple(fitted)


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, without: tuple[str, ...] = ()) -> Grammar:
    """Learn lexicons and calibration from the labelled rows whose crc32(doc_id) mod 4 is not 2."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_bucket("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary"))
    sample = materialize(known.orderBy(order, "doc_id").limit(fit_rows))
    rows = materialize(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"))  # the broadcast holds at most ``fit_rows`` rows
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return Grammar()
    grammar = learn_arcs(rows, sizes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ClauseAutomaton(grammar, without)
        for batch in batches:
            found = [automaton.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "f"])

    fit = rows.mapInArrow(measure, "toxic int, f array<double>").toArrow()  # at most ``fit_rows`` rows, but for repeated ids
    x = np.array(fit.column("f").to_pylist(), float)
    return Grammar(grammar.words, grammar.prefixes, calibrate(x, fit.column("toxic").to_numpy().astype(float)))


def score(documents: DataFrame, grammar: Grammar, column: str = "score", without: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` with a last column holding the toxicity of their texts, from 0 to 1."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ClauseAutomaton(grammar, without)
        for batch in batches:
            found = np.array([automaton.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability(grammar.coefficients, found))], names=[*batch.schema.names, column])

    return documents.mapInArrow(judge, T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, without: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents`` (doc_id, text)."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels, without=without), without=without)
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that aren't toxic, with their columns as they were."""
    return score(documents, train(documents, labels), column="__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")
