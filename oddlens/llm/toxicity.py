"""Toxicity by a weighted finite-state pattern grammar.

Six weighted transducers - what an insult is said of, insults, threats with their frames and objects, negation,
reported speech, targets - are composed to one machine. A text is scanned for trigger words by an automaton; the clause around a trigger is read as a
sequence of word classes, whose arcs carry the lexicon's weights, and scored by the best path through the machine. The
arcs of a path multiply: a match in a denied or reported clause is worth a fraction, one that is aimed at someone,
before or after it, is worth more. The score of a text is the chance that at least one of the matches on the best
paths of its clauses is toxic: 1 - product(1 - weight). Words alone score nothing that their clause takes back ("not
stupid", 'she said: "idiot"'). A threat needs a person as object or a frame of what is to come ("you will burn");
those without count once, and little, in a text. So does a word of the insult lexicon that is neither said of someone
("you are a clown", "you clown") nor called at someone ("clown!", "clown, you ..."): "the circus clown" is none. Words
that labelled data show to be toxic by themselves (PROVEN) match wherever they stand.

The insult lexicon holds fixed English words and, per labelled data, learned words and word stems: candidates
are counted in a sample of labelled documents (at most SAMPLE of each label) and chosen greedily, each for the
toxic documents that no earlier choice explains, so that words which merely come along in copied texts stay out.

Null and empty texts score 0. Case is ignored. Very long texts cost what their triggers cost.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache, partial
from math import log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import Batches, slices

SAMPLE = 6000  # labelled documents of each label that are learned from, at most about
STEM = (4, 5, 6, 7, 8)  # letters of a learned stem
THRESHOLD = 0.3
ALONE = 0.2  # a word of a stem that clean texts hold too: it takes two of them

# Fixed word lists of the grammar.
INSULTS = (
    "asshole bastard bitch clown coward cretin creep crook cunt degenerate dimwit dirtbag disgrace disgusting dumbass "
    "dumb fool freak garbage hypocrite idiot idiotic idiots imbecile jerk lazy liar loser losers lowlife lunatic "
    "maggot moron moronic morons nitwit parasite pathetic pig psycho rat retard retarded scum scumbag shithead sleazy "
    "slut stupid thug trash twit ugly vermin vile weakling whore worthless wretch"
).split()
MILD = "creep crook coward dumb fool freak garbage hypocrite jerk lazy liar lunatic maggot parasite pig rat thug ugly vile clown trash".split()
THREATS = "kill hurt destroy murder stab shoot beat strangle burn hang punish crush".split()
TARGETS = "you your yours yourself he him his she her hers they them their these those this that u ya everyone people".split()
NEGATIONS = "not no never neither nor none nobody without hardly isn't aren't wasn't weren't don't doesn't didn't won't can't cannot ain't".split()
REPORTS = "said says say saying wrote writes claimed claims quoted quotes reported reports alleged called accused according".split()
CONTRASTS = "but however although though yet".split()
# Of threats: who may be their object, whose is only one's own ("their record"), who speaks, and what is to come.
OBJECTS = "you yourself u ya him them everyone people".split()
OWNERS = "your yours his her hers their".split()
SUBJECTS = "i we".split()
FUTURE = "will shall gonna wanna going".split()
OUGHT = "should must ought".split()
SECOND = "you u ya yourself".split()
DEMONSTRATIVES = "this that these those".split()
COPULAS = "are is am was were been become became".split()
ARTICLES = "a an such so really very just quite too total complete absolute utter".split()
FILLERS = "all of every one each both the down up to be get".split()
OBJECT_REACH = 3  # words between a threat and its object, of FILLERS
STRONG = 0.5  # weight from which a word is an insult and can be aimed; below it is a hint
# Weights: of a plain lexicon word before data, of a threat with and without a target, and of contexts.
PLAIN, WEAK, THREAT, LONE_THREAT, BARE, NEGATED, REPORTED, AIMED = 0.85, 0.6, 0.7, 0.02, 0.1, 0.1, 0.3, 1.5
PROVEN = (3, 0.75)  # toxic documents at least, and part of the documents that hold a word, for it to match by itself

FIXED = frozenset(INSULTS)
_BREAK = re.compile(r"[.;!?\n|]+")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]|,")


class Transducer:
    """Weighted arcs (state, symbol) -> [(state, symbol out, weight)]; what has no entry keeps state and symbol at weight 1.

    An empty list of arcs ends a path. A path counts if it ends outside ``owing`` states.
    """

    def __init__(self, arcs: dict[tuple, list[tuple]], start="start", owing: frozenset = frozenset()):
        self.arcs, self.start, self.owing = arcs, start, owing

    def __call__(self, state, symbol: str) -> list[tuple]:
        return self.arcs.get((state, symbol), [(state, symbol, 1.0)])


def compose(machines: list[Transducer], alphabet: list[str]) -> Transducer:
    """One machine for the cascade: each reads what the one before writes, and weights multiply. States are tuples."""
    start = tuple(m.start for m in machines)
    arcs: dict[tuple, list[tuple]] = {}
    waiting, seen = [start], {start}
    while waiting:
        state = waiting.pop()
        for symbol in alphabet:
            paths: list[tuple] = [((), symbol, 1.0)]
            for machine, own in zip(machines, state, strict=True):
                paths = [((*to, x), out, w * v) for to, read, w in paths for x, out, v in machine(own, read)]
            arcs[state, symbol] = paths
            for to, _, _ in paths:
                if to not in seen:
                    seen.add(to)
                    waiting.append(to)
    owing = frozenset(x for x in seen if any(own in m.owing for own, m in zip(x, machines, strict=True)))
    return Transducer(arcs, start, owing)


def _said_of() -> Transducer:
    """A bound INSULT becomes a SLUR where it is said of someone or called at someone, and else is BARE.

    Said of: after "you" or after any person and a form of "be", articles and fillers between. Called: at the start of
    a clause or after a comma, with its end, a comma, a contrast or "you" next; that path owes it.
    """
    arcs: dict[tuple, list[tuple]] = {}
    keeps = ("ART", "THE", "FILLER", "NOT")
    for state in ("start", "mid", "comma", "second", "third", "is", "called"):
        for symbol in ALPHABET:
            to = "mid"
            if symbol in keeps:
                to = state
            elif symbol == "COMMA":
                to = "comma"
            elif symbol == "BUT":
                to = "start"
            elif symbol == "SECOND":
                to = "second"
            elif symbol in ("YOU", "OBJECT"):
                to = "third"
            elif symbol == "YOURE" or symbol == "COPULA" and state in ("second", "third"):
                to = "is"
            out = {"YOURE": "SECOND", "COPULA": "WORD", "DEM": "YOU"}.get(symbol, symbol)
            ends = state == "called" and symbol not in ("COMMA", "BUT", "SECOND", "YOURE")
            if symbol == "INSULT":
                said = [("mid", "SLUR", 1.0)] if state in ("second", "is") else [("mid", "BARE", 1.0)]
                arcs[state, symbol] = [] if ends else [*said, *([("called", "SLUR", 1.0)] if state in ("start", "comma") else [])]
            else:
                arcs[state, symbol] = [] if ends else [("mid" if to == "called" else to, out, 1.0)]
    return Transducer(arcs)


def _insults() -> Transducer:
    """Insults match as they stand or, by another path, as part of what is said to a target; hints only match."""
    return Transducer({("start", "SLUR"): [("start", "INSULT", 1.0), ("start", "AIMED", 1.0)]})


def _threats() -> Transducer:
    """A threat needs an object within OBJECT_REACH fillers, or a frame of what is to come: "you will burn" without a
    thing as object, "I will burn down their house" with one later on. By another path it stands alone. "You" is an
    object anywhere; others are where the speaker acts ("I", "we") or calls for it ("kill them", "they should hang"),
    not where something is told ("the people kill them with kindness").

    States are pairs: the frame (open, start, you, me, doom, vow) and what a threat before still owes (none; near0.. and
    you0.., an object within so many fillers; far; thing, no article next).
    """
    frames = ("open", "start", "you", "me", "doom", "vow")
    reach, second = ([f"{n}{k}" for k in range(OBJECT_REACH + 1)] for n in ("near", "you"))
    arcs: dict[tuple, list[tuple]] = {}

    def frame_after(frame: str, symbol: str) -> str:
        fixed = {"SECOND": "you", "SUBJECT": "me", "VOW": "vow", "OUGHT": "vow", "DOOM": "doom", "BUT": "open"}
        if symbol == "FUTURE":
            return {"you": "doom", "me": "vow"}.get(frame, frame)
        if symbol == "OBJECT" and frame != "vow":
            return "you"
        if frame == "open" and symbol not in ("FILLER", "THE", "COMMA", "NOT", "BUT", *fixed):
            return "start"
        if symbol in ("WORD", "ART", "SLUR", "INSULT", "BARE", "HINT", "AIMED", "COMMA") and frame in ("doom", "you"):
            return "start"
        return fixed.get(symbol, frame)

    def owed_after(owed: str, symbol: str) -> str | None:
        """What is owed after a symbol that is no threat; None ends the path."""
        if owed == "none":
            return "none"
        if owed == "thing":
            return None if symbol in ("ART", "THE", "OWNER") else "none"
        if symbol == "SECOND" or symbol == "OBJECT" and owed not in second:
            return "none"
        if owed == "far":
            return "none" if symbol == "OWNER" else None if symbol == "BUT" else "far"
        row = second if owed in second else reach
        k = row.index(owed)
        return row[k - 1] if symbol in ("FILLER", "THE") and k else None

    for frame in frames:
        for owed in ("none", *reach, *second, "far", "thing"):
            near = owed in reach or owed in second
            for symbol in ALPHABET:
                if symbol == "THREAT":
                    match = [((frame, (reach if frame in ("open", "me", "vow") else second)[-1]), "THREAT", 1.0)]
                    if frame == "doom" and not near:
                        match.append(((frame, "thing"), "THREAT", 1.0))
                    if frame == "vow" and not near:
                        match.append(((frame, "far"), "THREAT", 1.0))
                    arcs[(frame, owed), symbol] = match if near else [*match, ((frame, owed), "LONE", 1.0)]
                else:
                    owes = owed_after(owed, symbol)
                    out = {"SECOND": "OBJECT", "OUGHT": "FUTURE", "THE": "FILLER", "ART": "WORD"}.get(symbol, symbol)
                    arcs[(frame, owed), symbol] = [] if owes is None else [((frame_after(frame, symbol), owes), out, 1.0)]
    return Transducer(arcs, ("open", "none"), frozenset((f, owed) for f in frames for owed in (*reach, *second, "far")))


def _negation() -> Transducer:
    """A negation weakens what matches after it, up to a contrast or the end of the clause; "no," does not."""
    arcs: dict[tuple, list[tuple]] = {}
    for state in ("not", "denied"):
        arcs |= {(state, s): [("denied", s, NEGATED)] for s in MATCHES}
        arcs |= {(state, s): [("denied", s, 1.0)] for s in ALPHABET if s not in (*MATCHES, "NOT", "BUT", "COMMA")}
        arcs[state, "BUT"] = [("start", "BUT", 1.0)]
    arcs |= {(s, "NOT"): [("not", "NOT", 1.0)] for s in ("start", "not", "denied")}
    arcs["not", "COMMA"] = [("start", "COMMA", 1.0)]
    return Transducer(arcs)


def _reported() -> Transducer:
    """Speech that is reported before ("she said you are ..."), in quotes, or after it ("you are ..., he said").

    For the last, a match outside of quotes goes two ways: one ends where a comma or quote, somebody and SAY follow,
    the other owes just that and is weakened.
    """
    arcs: dict[tuple, list[tuple]] = {("start", "SAY"): [("said", "SAY", 1.0)], ("said", "BUT"): [("start", "BUT", 1.0)], ("start", "QUOTE"): [("quote", "QUOTE", 1.0)], ("said", "QUOTE"): [("quote", "QUOTE", 1.0)], ("quote", "QUOTE"): [("start", "QUOTE", 1.0)]}
    arcs |= {(state, s): [(state, s, REPORTED)] for state in ("said", "quote") for s in MATCHES}
    arcs |= {("start", s): [("free", s, 1.0), ("owes", s, REPORTED)] for s in MATCHES}
    for way, weight in (("free", 1.0), ("owes", REPORTED)):
        comma, speaker = f"{way} comma", f"{way} speaker"
        for state in (way, comma, speaker):
            arcs |= {(state, s): [(way, s, weight)] for s in MATCHES}
            arcs |= {(state, s): [(way, s, 1.0)] for s in ALPHABET if s not in MATCHES}
            arcs[state, "COMMA"] = [(comma, "COMMA", 1.0)]
            arcs[state, "QUOTE"] = [(comma, "QUOTE", 1.0)]
        arcs[way, "SAY"] = [("said", "SAY", 1.0)] if way == "free" else [(way, "SAY", 1.0)]
        arcs |= {(comma, s): [(speaker, s, 1.0)] for s in ("YOU", "WORD")}
        for state in (comma, speaker):
            arcs[state, "SAY"] = [] if way == "free" else [("said", "SAY", 1.0)]
    return Transducer(arcs, owing=frozenset({"owes", "owes comma", "owes speaker"}))


def _target() -> Transducer:
    """What is AIMED has a target in its part of the clause: before it, or, while a path owes one, after it."""
    arcs: dict[tuple, list[tuple]] = {}
    for state in ("start", "aimed", "owing"):
        arcs |= {(state, s): [("aimed", s, 1.0)] for s in AT}
        arcs[state, "AIMED"] = [("aimed" if state == "aimed" else "owing", "AIMED", 1.0)]
        arcs[state, "BUT"] = [] if state == "owing" else [("start", "BUT", 1.0)]
    return Transducer(arcs, owing=frozenset({"owing"}))


AT = ("YOU", "OBJECT", "OWNER", "DOOM")
MATCHES = ("INSULT", "AIMED", "HINT", "THREAT", "LONE", "BARE")
ONCE = {"LONE": LONE_THREAT, "BARE": BARE}  # what counts once in a text
ALPHABET = ["WORD", "INSULT", "SLUR", "HINT", "THREAT", *AT, "SECOND", "YOURE", "DEM", "COPULA", "ART", "THE", "SUBJECT", "FUTURE", "OUGHT", "VOW", "FILLER", "NOT", "BUT", "SAY", "QUOTE", "COMMA"]
KINDS = dict.fromkeys(FILLERS, "FILLER") | dict.fromkeys(TARGETS, "YOU") | dict.fromkeys(NEGATIONS, "NOT") | dict.fromkeys(REPORTS, "SAY") | dict.fromkeys(CONTRASTS, "BUT") | dict.fromkeys(SUBJECTS, "SUBJECT") | dict.fromkeys(FUTURE, "FUTURE") | dict.fromkeys(OUGHT, "OUGHT") | dict.fromkeys(DEMONSTRATIVES, "DEM") | dict.fromkeys(COPULAS, "COPULA") | dict.fromkeys(ARTICLES, "ART") | {"the": "THE"} | dict.fromkeys(OBJECTS, "OBJECT") | dict.fromkeys(SECOND, "SECOND") | dict.fromkeys(OWNERS, "OWNER") | {w + "'ll": "VOW" for w in SUBJECTS} | {"you'll": "DOOM", ",": "COMMA", "i'm": "SUBJECT", "we're": "SUBJECT", "you're": "YOURE", "ur": "YOURE"} | dict.fromkeys('"“”«»', "QUOTE")


@cache
def machine() -> Transducer:
    """The six transducers, composed."""
    return compose([_said_of(), _insults(), _threats(), _negation(), _reported(), _target()], ALPHABET)


class Grammar:
    """Lexicon: insult words, stems (ending in ``*``) and threats (beginning with ``!``) with the weights of their arcs.

    Words that begin with ``+``, stems and words outside the fixed list match by themselves: data have shown them to.
    """

    def __init__(self, insults: dict[str, float]):
        self.free = {w[1:] for w in insults if w.startswith("+")}
        insults = {w.lstrip("+"): p for w, p in insults.items()}
        self.threats = dict.fromkeys(THREATS, THREAT) | {w[1:]: p for w, p in insults.items() if w.startswith("!")}
        self.words = {w: p for w, p in insults.items() if not w.startswith("!") and not w.endswith("*")}
        self.stems = {w[:-1]: p for w, p in insults.items() if w.endswith("*")}
        self.lengths = sorted({len(w) for w in self.stems})
        self.scan = ahocorasick.Automaton()
        for word in {*self.words, *self.stems, *self.threats}:
            self.scan.add_word(word, len(word))
        self.scan.make_automaton()

    def weight(self, word: str) -> float:
        """Its own weight, else that of its stem."""
        own = self.words.get(word)
        return max((self.stems.get(word[:n], 0.0) for n in self.lengths), default=0.0) if own is None else own

    def read(self, text: str) -> list[tuple[str, str, float]]:
        """(word, symbol, weight of its arc) of a clause."""
        out = []
        for word in _TOKEN.findall(text):
            p = self.weight(word)
            if p:
                out.append((word, "HINT" if p < STRONG else "INSULT" if word in FIXED and word not in self.free else "SLUR", p))
            elif word in self.threats:
                out.append((word, "THREAT", self.threats[word]))
            else:
                out.append((word, KINDS.get(word.replace("’", "'"), "WORD"), 0.0))
        for k, (word, _, _) in enumerate(out):  # "her" is an object where no word follows that she could own
            if word == "her" and (k + 1 == len(out) or out[k + 1][1] not in ("WORD", "FILLER", "INSULT", "SLUR", "HINT")):
                out[k] = (word, "OBJECT", 0.0)
        return out

    def clause(self, text: str) -> list[tuple[str, str, float, float]]:
        """(word, symbol, chance, weight of the context) of the matches on the clause's best path.

        A match with chance p adds evidence -log(1 - p); the best path is the one with most evidence.
        """
        fsm = machine()
        paths: dict[tuple, tuple[float, tuple | None]] = {fsm.start: (0.0, None)}
        for word, symbol, p in self.read(text):
            new: dict[tuple, tuple[float, tuple | None]] = {}
            for state, (evidence, found) in paths.items():
                for to, out, w in fsm(state, symbol):
                    more, then = evidence, found
                    if out in MATCHES:
                        chance = w * (ONCE[out] if out in ONCE else 1 - (1 - p) ** AIMED if out == "AIMED" else p)
                        # What counts once in a text is worth no path.
                        more, then = evidence + (0.0 if out in ONCE else -log1p(-min(chance, 0.999999))), (found, (word, out, chance, w))
                    if to not in new or more > new[to][0]:
                        new[to] = (more, then)
            paths = new
        _, found = max((x for state, x in paths.items() if state not in fsm.owing), key=lambda x: x[0])
        out = []
        while found:
            found, match = found
            out.append(match)
        return out[::-1]

    def clauses(self, text: str | None) -> list[tuple[int, str, str, float, float]]:
        """(character position of the clause, word, symbol, chance, weight of the context) of all matches of a text."""
        if not text:
            return []
        low, out, done = text.lower(), [], 0
        for end, n in self.scan.iter(low):
            begin = end - n + 1
            if begin < done or begin and (low[begin - 1].isalnum() or low[begin - 1] == "_"):
                continue
            left = max(max(low.rfind(c, done, begin) for c in ".;!?\n|") + 1, done)
            stop = _BREAK.search(low, begin)
            right = stop.start() if stop else len(low)
            out += [(left, *m) for m in self.clause(low[left:right])]
            done = right
        return out

    def score(self, text: str | None) -> float:
        rest, once = 1.0, dict.fromkeys(ONCE, 0.0)
        for _, _, symbol, p, _ in self.clauses(text):
            if symbol in ONCE:  # however long the text
                once[symbol] = max(once[symbol], p)
            else:
                rest *= 1 - p
        for p in once.values():
            rest *= 1 - p
        return 1 - rest


def _features(text: str | None) -> set[str]:
    """Words of a text, and the stems (with ``*``) of its longer words."""
    words = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if len(w) > 2}
    return words | {f"{w[:n]}*" for w in words for n in STEM if len(w) > n}


def _counted(batches: Batches) -> Batches:
    """Documents of each label that hold a feature, or a threat (``!`` before its word) that nothing takes back."""
    threats = Grammar({})
    for batch in batches:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            count[toxic].update(_features(text) | {f"!{w}" for _, w, symbol, _, context in threats.clauses(text) if symbol == "THREAT" and context == 1})
        names = list(count[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([0] * len(names), pa.int64())], ["feature", "bad", "good"])
        names = list(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([count[0][x] for x in names], pa.int64())], ["feature", "bad", "good"])


def _present(batches: Batches, names: frozenset[str]) -> Batches:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sorted(names & _features(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], ["found"])


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """Texts with their label: about ``most`` rows of each label, chosen by a hash of doc_id.

    The chosen ids are few (2 * ``most``), so they are sent to the documents and no text is shuffled. Each row stands for ``weight`` rows.
    """
    labels = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    sizes = {r[label]: r.n for r in labels.groupBy(label).agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for value, n in sizes.items():
        rate = F.when(F.col(label) == value, F.lit(min(1.0, most / n))).otherwise(rate)
    labels = labels.withColumn("rate", rate).withColumn("weight", 1 / F.greatest(F.col("rate"), F.lit(1e-12)))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.col("rate") * 1_000_000).drop("rate")
    return docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar with what labelled documents (labels: doc_id, toxic 0/1) say about lexicon words, and learned ones.

    Stems come first: greedily, the one that is purest and explains most toxic documents without a known insult,
    at least three of them, while at least half of the documents that hold it are toxic. The words of a chosen stem
    then weigh what their own counts say, its unseen words little unless the stem itself is pure. Without labels the
    fixed lexicon stays as it is.
    """
    rows = sample(docs, labels, "toxic").select("text", "toxic", "weight").persist()
    try:
        good_weight = rows.where("toxic = 0").agg(F.first("weight")).first()[0] or 1.0
        counts = rows.mapInArrow(_counted, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), (F.sum("good") * good_weight).alias("good")).persist()
        fixed = {r.feature: (r.bad, r.good) for r in counts.where(F.col("feature").isin([*INSULTS, *(f"!{w}" for w in THREATS)])).collect()}
        able = counts.where("bad >= 3 AND good <= bad AND NOT startswith(feature, '!')").collect()  # of the bounded sample
        table = {r.feature: (r.bad, r.good) for r in able}
        toxic = rows.where("toxic = 1").select("text").mapInArrow(partial(_present, names=frozenset({*table, *INSULTS})), "found array<string>").collect()
        prior = {w: WEAK if w in MILD else PLAIN for w in INSULTS} | {f"!{w}": THREAT for w in THREATS}
        lexicon = {w: (p * 2 + fixed.get(w, (0, 0))[0]) / (2 + sum(fixed.get(w, (0, 0)))) for w, p in prior.items()}
        stems = _explain([set(r.found) for r in toxic], {w.lstrip("+!") for w, p in lexicon.items() if p >= STRONG and w.startswith(("+", "!"))}, table)
        least, part = PROVEN
        for w in INSULTS:
            bad, good = fixed.get(w, (0, 0))
            if bad >= least and bad >= part * (bad + good):
                lexicon["+" + w] = lexicon.pop(w)
        for stem, purity in stems.items():
            lexicon.pop(stem, None)
            lexicon[("+" if stem in FIXED else "") + stem] = 0.9 * purity**3
        starts = [w[:-1] for w in stems if w.endswith("*")]
        if starts:
            begins = F.col("feature").startswith(starts[0])
            for w in starts[1:]:
                begins |= F.col("feature").startswith(w)
            for r in counts.where(begins & ~F.col("feature").endswith("*")).collect():
                base = max(lexicon[w + "*"] for w in starts if r.feature.startswith(w))
                if "+" + r.feature in lexicon:
                    continue
                lexicon[r.feature] = min((r.bad + base) / (r.bad + r.good + 1), ALONE if base < STRONG else 1)
        counts.unpersist()
    finally:
        rows.unpersist()
    return Grammar(lexicon)


def _explain(texts: list[set[str]], known: set[str], table: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Words and stems that explain the texts which hold nothing known, with their purity."""
    purity = {x: bad / (bad + good + 0.5) for x, (bad, good) in table.items()}
    left = [found & table.keys() for found in texts if not known & found]
    out: dict[str, float] = {}
    while left:
        gain = Counter(x for found in left for x in found)
        best = max((x for x in gain if gain[x] >= 3), key=lambda x: (gain[x] * purity[x], len(x), x), default=None)
        if best is None:
            break
        out[best] = purity[best]
        left = [found for found in left if best not in found]
    return out


def _scored(batches: Batches, grammar: dict[str, float]) -> Batches:
    grammar = Grammar(grammar)
    for batch in slices(batches):
        scores = np.array([grammar.score(t) for t in batch.column("text").to_pylist()], float)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])


def _kept(batches: Batches, grammar: dict[str, float]) -> Batches:
    grammar = Grammar(grammar)
    for batch in slices(batches):
        yield batch.filter(pa.array([grammar.score(t) < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))


def lexicon_of(grammar: Grammar) -> dict[str, float]:
    return {("+" if w in grammar.free else "") + w: p for w, p in grammar.words.items()} | {f"{w}*": p for w, p in grammar.stems.items()} | {f"!{w}": p for w, p in grammar.threats.items()}


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score (0 to 1) for each row of ``docs`` (doc_id, text; others are ignored)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_scored, grammar=lexicon_of(grammar)), f"doc_id {kind}, score double")


def reject(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more; all columns stay."""
    return docs.mapInArrow(partial(_kept, grammar=lexicon_of(grammar)), docs.schema)
