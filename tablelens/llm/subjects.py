"""Subject areas of commits, by calibrated classifier chains.

The model is trained on the driver from a bounded sample of labelled documents
(``sample`` of fit_subjects) and applied to every document, whole texts.

1. Terms: of each word of the sample the subject whose documents it stands in, or
   the subjects, where it is as telling for several. A word that the sample lacks is matched by its accents, its stem, or one
   slip of the pen.
2. Lines: a message line or changed line with terms is weighed by the words
   around them, learned as a logistic model, so that passing mentions and word
   lists count little. Unchanged lines are never read.
3. Chain: one link per subject over the evidence of its terms, the document's
   structure and source, and the labels of the links before it. A link's weights of
   evidence are shared ones and its own difference from them; bias, source,
   co-occurrence and what it makes of a document without its terms are its own.
   Evidence for training is cross-fitted, and each link's output is calibrated on it.
4. Decoding: beam search over the chain gives the best combination of labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import canonical_source
from tablelens.shared import exact, materialize, ship

_WORD = re.compile(r"[A-ZÀ-ÖØ-ÞŒ]?[a-zß-öø-ÿœ]+|[A-ZÀ-ÖØ-ÞŒ]+(?![a-zß-öø-ÿœ])")
_BOT = re.compile(r"bot\b|robot|\bauto", re.I)
MESSAGE, CHANGE, PATH = 0, 1, 2
_EVIDENCE = 34
SHARED_TERM = 5  # documents of each that make a word a term of two subjects
_OWN = 0.5  # scale of a link's difference from the shared weights


def fold(word: str) -> str:
    """Lower case without accents."""
    low = word.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


@dataclass
class Lines:
    """The counted lines of a document, and its structure."""

    lines: list[tuple[int, list[str]]]  # zone, raw words
    n_changed: int
    n_single: int
    n_files: int
    bot: bool


def read_lines(text: str | None) -> Lines:
    """Message lines, changed lines and file names of a commit. A text without a
    diff is all message. Null and empty texts have no lines. Lines with +++ or --- are
    headers between a file's name and its first hunk only; within hunks they are changes."""
    out: list[tuple[int, list[str]]] = []
    changed = single = files = 0
    in_diff, in_hunk, bot = False, False, False
    find = _WORD.findall
    for line in (text or "").splitlines():
        if line.startswith("diff --git "):
            in_diff, in_hunk = True, False
            files += 1
            words = find(line[11:].removeprefix("a/").partition(" b/")[0])
            out.append((PATH, words))
        elif not in_diff:
            if line:
                out.append((MESSAGE, find(line)))
                if not bot and _BOT.search(line):
                    bot = True
        elif line.startswith("@@"):
            in_hunk = True
        elif line[:1] in ("+", "-") and (in_hunk or not line.startswith(("+++ ", "--- "))):
            words = find(line)
            changed += 1
            if words:
                out.append((CHANGE, words))
                if len(line) <= len(words[0]) + 2 or (len(words) <= 2 and " " not in line[1:].strip() and line[1:].strip().replace("-", "").isalpha()):
                    single += 1
    return Lines(out, changed, single, files, bot)


# ---------------------------------------------------------------- terms


@dataclass
class Terms:
    """Folded word -> numbers of its subjects; plain words that are no term."""

    subject: dict[str, tuple[int, ...]]
    plain: set[str]
    slips: dict[str, tuple[int, ...]] = field(default_factory=dict)
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.slips:
            for word, s in self.subject.items():
                if len(word) >= 5:
                    for i in range(len(word)):
                        cut = word[:i] + word[i + 1 :]
                        self.slips[cut] = () if self.slips.get(cut, s) != s else s

    def of(self, raw: str) -> tuple[int, ...]:
        """The subjects of a word, mostly none or one."""
        known = self.cache.get(raw)
        if known is None:
            known = self._match(fold(raw))
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[raw] = known
        return known

    def _match(self, word: str) -> tuple[int, ...]:
        s = self.subject.get(word)
        if s is not None:
            return s
        if len(word) < 4 or word in self.plain:
            return ()
        for cut in range(1, min(5, len(word) - 3)):  # endings
            stem = word[:-cut]
            s = self.subject.get(stem)
            if s is not None:
                return s
        if len(word) >= 8:  # compounds
            for n in range(len(word) - 5, 4, -1):
                s = self.subject.get(word[:n])
                if s is not None:
                    return s
        if len(word) >= 5:  # one letter left out, put in, changed or swapped with the next
            s = self.slips.get(word)
            if s:
                return s
            for i in range(len(word)):
                cut_word = word[:i] + word[i + 1 :]
                s = self.subject.get(cut_word) if len(cut_word) >= 5 else None
                if s is None:
                    s = self.slips.get(cut_word)
                if s:
                    return s
        return ()


def learn_terms(docs: list[Lines], labels: list[frozenset[int]], n_subjects: int, rounds: int = 2) -> Terms:
    """Words that stand mostly in documents of one subject. From the second round
    on, a document tells about the subjects it is labelled with only where the
    words of others don't outnumber them, which keeps word lists out."""
    bags = [{fold(w) for zone, words in d.lines if zone != PATH for w in words if len(w) > 2} for d in docs]
    base = np.bincount([s for y in labels for s in y], minlength=n_subjects) / max(1, len(docs))
    terms: dict[str, tuple[int, ...]] = {}
    total: Counter = Counter()
    for step in range(rounds):
        by: defaultdict[str, Counter] = defaultdict(Counter)
        total = Counter()
        for bag, y in zip(bags, labels):
            if step and len({terms[w] for w in bag if w in terms}) >= 4:
                continue
            total.update(bag)
            for s in y:
                for w in bag:
                    by[w][s] += 1
        terms = {}
        for w, counts in by.items():
            telling = []
            for s, k in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
                share = (k + 2 * base[s]) / (total[w] + 2)
                if k >= 2 and share >= 0.4 and share * (1 - base[s]) >= 4 * base[s] * (1 - share):
                    telling.append(s)
            if not telling or telling[0] != min(counts, key=lambda s: (-counts[s], s)):
                continue
            first = telling[0]
            k = counts[first]
            if k > 1.4 * max((c for o, c in counts.items() if o != first), default=0) and sum(counts.values()) - k <= 1.2 * k:
                terms[w] = (first,)
            elif len(telling) == 2 and counts[telling[1]] >= SHARED_TERM:  # as telling for one as for the other
                terms[w] = tuple(sorted(telling))
    plain = {w for w, n in total.items() if n >= 4 and w not in terms}
    return Terms(terms, plain)


# ---------------------------------------------------------------- lines


@dataclass
class Hit:
    zone: int
    counts: dict[int, set[str]]  # subject -> its words in the line
    context: list[str]


def hits_of(doc: Lines, terms: Terms) -> list[Hit]:
    """The lines with terms, and what stands around the terms."""
    out = []
    of, known = terms.of, terms.cache.get
    for zone, words in doc.lines:
        found: dict[int, set[str]] | None = None
        for w in words:
            its = known(w)
            if its is None:
                its = of(w)
            for s in its:
                if found is None:
                    found = {}
                found.setdefault(s, set()).add(w)
        if found:
            rest = [w.lower() for w in words if not of(w)]
            mark = ("m:", "c:", "p:")[zone]
            context = [mark + w for w in rest] + [mark + "#", f"{mark}#{min(len(rest), 4)}", f"{mark}@{min(len(found), 3)}"]
            context += [f"{mark}{a}_{b}" for a, b in zip(rest, rest[1:])]
            out.append(Hit(zone, found, context))
    return out


def _fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, l2: float, steps: int = 60, weight: np.ndarray | None = None) -> np.ndarray:
    """Sparse logistic regression by accelerated gradient steps with diagonal scaling."""
    n = len(y)
    w, v, t = np.zeros(width), np.zeros(width), 1.0
    weight = np.ones(n) if weight is None else weight
    reach = np.bincount(rows, np.abs(vals), minlength=n)
    scale = np.bincount(cols, np.abs(vals) * reach[rows] * weight[rows] * 0.25, minlength=width) + l2
    for _ in range(steps):
        z = np.bincount(rows, vals * v[cols], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(cols, vals * g[rows], minlength=width) + l2 * v
        new = v - grad / scale
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def learn_gate(docs: list[list[Hit]], labels: list[frozenset[int]]) -> dict[str, float]:
    """Weights of contexts: whether a line's terms are what the document is about."""
    seen: Counter = Counter(c for hits in docs for h in hits for c in h.context)
    index = {c: k for k, c in enumerate(c for c, n in seen.items() if n >= 3)}
    rows, cols, ys = [], [], []
    for hits, y in zip(docs, labels):
        for h in hits:
            if h.zone == PATH:
                continue
            picked = [index[c] for c in h.context if c in index]
            for s in h.counts:
                rows.extend([len(ys)] * len(picked))
                cols.extend(picked)
                ys.append(s in y)
    if not ys:
        return {}
    w = _fit_logistic(np.array(rows), np.array(cols), np.ones(len(rows)), np.array(ys, float), len(index), 2.0)
    return {c: float(w[k]) for c, k in index.items()}


# ---------------------------------------------------------------- evidence


def _bins(x: float, edges: tuple[float, ...]) -> list[float]:
    return [1.0 if x > e else 0.0 for e in edges]


def evidence(doc: Lines, hits: list[Hit], gate: dict[str, float], n_subjects: int) -> np.ndarray:
    """What speaks for each subject: an array (subjects, _EVIDENCE)."""
    out = np.zeros((n_subjects, _EVIDENCE))
    strong: dict[int, list[float]] = {}
    words: dict[int, set[str]] = {}
    first_message = True
    for h in hits:
        z = sum(gate.get(c, 0.0) for c in h.context)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        for s, found in h.counts.items():
            x = strong.setdefault(s, [0.0] * 9)  # message, change, path, best message, best change, low message, low change, first, number
            if h.zone == PATH:
                x[2] += 1
                continue
            x[h.zone] += p
            x[3 + h.zone] = max(x[3 + h.zone], p)
            x[5 + h.zone] += 1 - p
            x[8] += 1
            if h.zone == MESSAGE and first_message:
                x[7] = p
            words.setdefault(s, set()).update(fold(w) for w in found)
        first_message = first_message and h.zone != MESSAGE
    total = sum(x[0] + x[1] for x in strong.values()) or 1.0
    spread = len([1 for x in strong.values() if x[8] > 0])
    ranked = sorted((x[0] + x[1] for x in strong.values()), reverse=True)
    listy = doc.n_single / max(1, doc.n_changed)
    for s, x in strong.items():
        own = x[0] + x[1]
        above = sum(r > own for r in ranked)
        distinct = len(words.get(s, ()))
        out[s] = [
            math.log1p(x[0]), math.log1p(x[1]), math.log1p(x[2]), x[3], x[4], math.log1p(x[5]), math.log1p(x[6]), x[7],
            own / total, float(x[8] > 0), *_bins(own, (0.3, 0.6, 1.0, 1.6, 2.5, 4.0)), *_bins(distinct, (1, 2, 3, 5)), *_bins(above, (0, 1, 2)),
            *_bins(spread, (1, 2, 3, 5)), listy * own, listy, float(doc.n_changed == 0), math.log1p(doc.n_changed), float(doc.bot), math.log1p(doc.n_files), math.log1p(x[8]),
        ]
    return out


# ---------------------------------------------------------------- the chain


@dataclass
class Links:
    """The links' weights. own: (subjects, bias, sources + 1, no evidence, earlier labels)."""

    evidence: np.ndarray  # (subjects, evidence)
    own: np.ndarray
    n_sources: int

    def fixed(self, x: np.ndarray, source: np.ndarray) -> np.ndarray:
        """What does not depend on labels: (documents, subjects)."""
        none = ~x.any(axis=2)
        return np.einsum("nsf,sf->ns", x, self.evidence) + self.own[:, 0] + self.own[:, 1:][:, source].T + none * self.own[:, 2 + self.n_sources]

    @property
    def after(self) -> np.ndarray:
        return self.own[:, 3 + self.n_sources :]


@dataclass
class SubjectModel:
    subjects: list[str]
    order: list[int]
    terms: Terms
    gate: dict[str, float]
    links: Links
    sources: dict[str, int]
    slope: np.ndarray
    shift: np.ndarray
    beam: int = 4

    def features(self, text: str | None) -> np.ndarray | None:
        """Evidence of a text; None where no term speaks for anything."""
        doc = read_lines(text)
        hits = hits_of(doc, self.terms)
        return evidence(doc, hits, self.gate, len(self.subjects)) if hits else None

    def decode(self, x: np.ndarray, source: np.ndarray) -> np.ndarray:
        """The best combination of labels of each document, by beam search:
        x (documents, subjects, evidence), source numbers; a boolean array."""
        n, k = len(x), len(self.subjects)
        fixed, some = self.links.fixed(x, source), x.any(axis=2)
        labels = np.zeros((n, 1, k), bool)
        score = np.zeros((n, 1))
        after = self.links.after
        for s in self.order:
            z = fixed[:, s, None] + labels @ after[s]
            z = np.where(some[:, s, None], self.slope[s] * z + self.shift[s], z)
            yes = np.concatenate([labels, labels], axis=1)
            yes[:, labels.shape[1] :, s] = True
            both = np.concatenate([score - np.logaddexp(0, z), score - np.logaddexp(0, -z)], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, : self.beam]
            labels = np.take_along_axis(yes, best[:, :, None], axis=1)
            score = np.take_along_axis(both, best, axis=1)
        return labels[:, 0]


def _chain(x: np.ndarray, source: np.ndarray, y: np.ndarray, order: list[int], n_sources: int, l2: float) -> Links:
    """Fits all links at once. Documents without evidence for a subject are rows of its
    link too, those alike as one row with their number as weight."""
    n, k, f = x.shape
    per = 1 + n_sources + 1 + 1 + k + f
    rows, cols, vals, ys, weight = [], [], [], [], []
    count = 0

    def add(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> None:
        rows.append(r)
        cols.append(c)
        vals.append(v)

    for place, s in enumerate(order):
        some = x[:, s].any(axis=1)
        at, rest = np.flatnonzero(some), np.flatnonzero(~some)
        earlier = order[:place]
        like = np.column_stack([source[rest], y[rest][:, earlier], y[rest, s]]).astype(np.int64)
        kinds, size = np.unique(like, axis=0, return_counts=True) if len(rest) else (np.zeros((0, place + 2), np.int64), np.zeros(0))
        base = f + s * per
        block = x[at, s]
        r, c = np.nonzero(block)
        add(r + count, c, block[r, c])
        add(r + count, c + base + per - f, _OWN * block[r, c])
        here = np.arange(len(at) + len(kinds)) + count
        add(here, np.full(len(here), base), np.ones(len(here)))
        add(here, base + 1 + np.concatenate([source[at], kinds[:, 0]]), np.full(len(here), 0.5))
        add(here[len(at) :], np.full(len(kinds), base + 2 + n_sources), np.ones(len(kinds)))
        labels = np.concatenate([y[at][:, earlier], kinds[:, 1:-1].astype(bool)])
        for i, before in enumerate(earlier):
            on = here[labels[:, i]]
            add(on, np.full(len(on), base + 3 + n_sources + before), np.full(len(on), 0.7))
        ys.append(np.concatenate([y[at, s], kinds[:, -1]]))
        weight.append(np.concatenate([np.ones(len(at)), size]))
        count += len(here)
    w = _fit_logistic(np.concatenate(rows), np.concatenate(cols).astype(np.int64), np.concatenate(vals), np.concatenate(ys).astype(float), f + k * per, l2, steps=300, weight=np.concatenate(weight))
    own = w[f:].reshape(k, per)
    links = Links(w[:f] + _OWN * own[:, per - f :], own[:, : per - f].copy(), n_sources)
    links.own[:, 1 : 2 + n_sources] *= 0.5
    links.own[:, 3 + n_sources :] *= 0.7
    return links


def train(texts: list[str | None], sources: list[str], labels: list[frozenset[str]], subjects: list[str], folds: int = 3) -> SubjectModel:
    """A model from labelled documents; an empty set of labels means no subject."""
    if not subjects:
        return SubjectModel([], [], Terms({}, set()), {}, Links(np.zeros((0, _EVIDENCE)), np.zeros((0, 3)), 0), {}, np.ones(0), np.zeros(0))
    number = {s: k for k, s in enumerate(subjects)}
    y_sets = [frozenset(number[s] for s in y if s in number) for y in labels]
    names = [s for s, n in Counter(sources).most_common() if n >= 20]
    source_of = {s: k for k, s in enumerate(sorted(names))}
    docs = [read_lines(t) for t in texts]
    k = len(subjects)
    x = np.zeros((len(docs), k, _EVIDENCE))
    for fold_no in range(folds):
        inside = [i for i in range(len(docs)) if i % folds != fold_no]
        terms = learn_terms([docs[i] for i in inside], [y_sets[i] for i in inside], k)
        inside_hits = [hits_of(docs[i], terms) for i in inside]
        gate = learn_gate(inside_hits, [y_sets[i] for i in inside])
        for i in range(fold_no, len(docs), folds):
            x[i] = evidence(docs[i], hits_of(docs[i], terms), gate, k)
    terms = learn_terms(docs, y_sets, k)
    gate = learn_gate([hits_of(d, terms) for d in docs], y_sets)
    y = np.zeros((len(docs), k), bool)
    for i, ys in enumerate(y_sets):
        y[i, list(ys)] = True
    src = np.array([source_of.get(s, len(source_of)) for s in sources], int)
    order = sorted(range(k), key=lambda s: (-int(y[:, s].sum()), subjects[s]))
    half = np.arange(len(docs)) % 2 == 0
    # calibration on documents the chain did not see
    links = _chain(x[half], src[half], y[half], order, len(source_of), 1.0)
    slope, shift = _calibrate(x[~half], src[~half], y[~half], order, links)
    links = _chain(x, src, y, order, len(source_of), 1.0)
    return SubjectModel(subjects, order, terms, gate, links, source_of, slope, shift)


def _slope_and_shift(z: np.ndarray, t: np.ndarray, least: int, otherwise: tuple[float, float]) -> tuple[float, float]:
    """By logistic regression; otherwise where there are too few documents of a kind."""
    n = len(t)
    if min(t.sum(), n - t.sum()) < least:
        return otherwise
    w = _fit_logistic(np.repeat(np.arange(n), 2), np.tile([0, 1], n), np.stack([z, np.ones(n)], 1).ravel(), t, 2, 1.0, steps=200)
    return (float(w[0]), float(w[1])) if w[0] > 0.05 else otherwise


def _calibrate(x: np.ndarray, source: np.ndarray, y: np.ndarray, order: list[int], links: Links) -> tuple[np.ndarray, np.ndarray]:
    """Slope and shift of each link's output on held-out documents with evidence; those
    of all links together where one has few."""
    fixed, some = links.fixed(x, source), x.any(axis=2)
    zs, ts = {}, {}
    for place, s in enumerate(order):
        at, earlier = np.flatnonzero(some[:, s]), order[:place]
        zs[s] = fixed[at, s] + y[at][:, earlier] @ links.after[s, earlier]
        ts[s] = y[at, s].astype(float)
    everyone = _slope_and_shift(np.concatenate([zs[s] for s in order]), np.concatenate([ts[s] for s in order]), 10, (1.0, 0.0))
    found = [_slope_and_shift(zs[s], ts[s], 100, everyone) for s in range(x.shape[1])]
    return np.array([a for a, _ in found]), np.array([b for _, b in found])


# ---------------------------------------------------------------- on Spark


def fit_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = 10_000, longest: int = 20_000, sample_chars: int = 24_000_000) -> SubjectModel:
    """A model from at most ``sample`` labelled documents, taken by a hash of
    doc_id, and of those as many as have ``sample_chars`` characters together, chosen
    before any text goes to the driver, which bounds its memory; labelled documents of more than ``longest``
    characters are no training rows. Everything else than this fit sees all
    documents, whole.

    A null subject means none; a document with several labels has all of them.
    Without labels the model gives no subject to any document.
    """
    names = sorted(r[0] for r in exact(subjects, "subject").filter(F.col("subject").isNotNull()).distinct().collect())
    picked = (
        exact(labels, "doc_id", "subject").filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("labels"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    labelled = exact(docs, "doc_id", "text", "source").select("doc_id", "text", canonical_source(F.col("source")).alias("source")).filter(F.length("text") <= longest)
    picked = picked.withColumnRenamed("doc_id", "labelled_id")  # at most sample rows
    joined = labelled.join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "source", "labels")
    joined = materialize(joined, "labelled")  # at most sample rows of at most longest characters
    sizes = joined.select("h", "doc_id", F.length("text").alias("n")).orderBy("h", "doc_id", "text").collect()
    within = int((np.cumsum([r["n"] for r in sizes]) <= sample_chars).sum()) if sizes else 0
    rows = joined.orderBy("h", "doc_id", "text").limit(within).collect()  # of at most sample_chars characters
    return train([r["text"] for r in rows], [r["source"] or "" for r in rows], [frozenset(r["labels"]) for r in rows], names)


def _predict(batches: Iterator[pa.RecordBatch], model: SubjectModel, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    none = len(model.sources)
    k = len(model.subjects)
    bare: dict[int, bool] = {}  # sources of which a document without any term has a subject
    for batch in batches:
        rows, found, sources = [], [], []
        for row, (text, name) in enumerate(zip(batch["text"], batch["source"].to_pylist())):
            x, source = model.features(text.as_py()), model.sources.get(name or "", none)
            if x is None and k:
                if source not in bare:
                    bare[source] = bool(model.decode(np.zeros((1, k, _EVIDENCE)), np.array([source])).any())
                x = np.zeros((k, _EVIDENCE)) if bare[source] and text.as_py() else None
            if x is not None:
                rows.append(row)
                found.append(x)
                sources.append(source)
        if not rows or not k:
            continue
        labels = model.decode(np.stack(found), np.array(sources, int))
        doc, subject = np.nonzero(labels)
        at = pa.array([rows[i] for i in doc], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in ("doc_id", *keep)), pa.array([model.subjects[s] for s in subject], pa.string())], ["doc_id", *keep, "subject"])


def assign_subjects(docs: DataFrame, model: SubjectModel, *keep: str) -> DataFrame:
    """(doc_id, subject) of every document that is about a subject, from its whole
    text; keep may be "source", in one spelling. Null and empty texts have none. No
    shuffle; what is broadcast is the model, which the training sample bounds."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = exact(docs, "doc_id", "text", "source").select("doc_id", "text", canonical_source(F.col("source")).alias("source"))
    return rows.mapInArrow(lambda b: _predict(b, shared.value, keep), f"doc_id bigint, {''.join(f'{c} string, ' for c in keep)}subject string")
