"""License scans: a generalised suffix automaton over the word sequences of licence templates.

A document's words are streamed through the automaton, which gives for each word the longest template passage that
ends there (matching statistics). Passages of at least `min_match` words are chained: those of one template, in order
of both the text and the template, cover a span of it; a template covered to at least `min_cover` gives its label. A passage that a template holds
several times may stand in a chain at any of its places. No chain is cut short: each match sees all earlier ones.
Marker phrases are templates of their own: a place is a word at which the whole phrase ends.

The templates are in licences.txt beside this module (a line `## label`, then the words of a licence text or notice), or whatever the caller gives.
Words outside the templates reset the automaton, so only runs of template words are walked.

Defined results: a null or empty text has no words, no labels and score 0; a very long text is walked word by word, with memory for its matches;
repeated rows are scanned alike, each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from labelweave.llm import common

#: phrase: label
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATE_FILE = Path(__file__).with_name("licences.txt")
MIN_MATCH, MIN_COVER = 5, 0.5
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def read_templates(path: str | Path = TEMPLATE_FILE) -> list[tuple[str, str]]:
    """(label, text) of each template of a file."""
    parts = Path(path).read_text(encoding="utf-8").split("## ")[1:]
    return [(label.strip(), text.strip()) for label, _, text in (x.partition("\n") for x in parts)]


def tokens(text: str) -> list[str]:
    data = common.lowered(np.frombuffer(text.encode(), dtype=np.uint8))
    starts, stops, _ = common.words(data, np.array([0, len(data)]), alnum=True)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, stops)]


class SuffixAutomaton:
    """Of several word sequences; each state of passages of `least` words or more knows where in which sequences they end: all places."""

    def __init__(self, sequences: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, set[int]]] = [{}]  # sequence: where
        for t, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].setdefault(t, set()).add(i)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):  # a suffix ends where its extension does
            if self.length[self.link[s]] >= least:
                for t, at in ends[s].items():
                    ends[self.link[s]].setdefault(t, set()).update(at)
        self.ends = [{t: sorted(at) for t, at in x.items()} if n >= least else {} for x, n in zip(ends, self.length)]

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q, ends)
        new = self._state(self.length[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q, ends)
        return new

    def _state(self, length: int, edges: dict, link: int, ends: list) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        ends.append({})
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int, ends: list) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def matches(self, sequence: list[int]):
        """(state, length of the longest match) at each word."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, phrases: dict[str, str], templates, min_match: int, min_cover: float):
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        texts = [tokens(x) for x in [*phrases, *(text for _, text in templates)]]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.sizes, self.n_phrases = [len(t) for t in texts], len(phrases)
        self.min_match, self.min_cover = min_match, min_cover
        self.automaton = SuffixAutomaton([[self.ids[w] for w in t] for t in texts], min_match)
        self.places = self._places([[self.ids[w] for w in t] for t in texts[: self.n_phrases]])

    def _places(self, phrases: list[list[int]]) -> list[tuple[int, ...]]:
        """By state: the phrases that end wherever the state's longest passage does, with the needed match length."""
        at: dict[int, list[int]] = {}
        for k, phrase in enumerate(phrases):
            if not phrase:
                continue
            *_, (state, length) = self.automaton.matches(phrase)
            assert length == len(phrase)
            at.setdefault(state, []).append(k)
        a, out = self.automaton, [()] * len(self.automaton.next)
        for s in sorted(range(1, len(out)), key=lambda s: a.length[s]):
            out[s] = (*at.get(s, ()), *out[a.link[s]])
        return out

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, float]]:
        """ids: of a document's words, -1 outside the templates. Phrase places (start, phrase) and covers by template."""
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return [], {}
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        places: list[tuple[int, int]] = []
        chains: dict[int, list[tuple[int, Sequence[int], int]]] = {}
        a = self.automaton
        for run in np.split(known, cuts):
            first, statistics = int(run[0]), list(a.matches(ids[run].tolist()))
            for i, (state, length) in enumerate(statistics):
                for k in self.places[state]:
                    if length >= self.sizes[k]:
                        places.append((first + i + 1 - self.sizes[k], k))
                if length >= self.min_match and (i + 1 == len(statistics) or statistics[i + 1][1] <= length):  # maximal
                    for t, ends in a.ends[state].items():
                        if t >= self.n_phrases:
                            chains.setdefault(t, []).append((first + i, ends, length))
        return places, {t: self._cover(t, matches) for t, matches in chains.items()}

    def _cover(self, template: int, matches: list[tuple[int, Sequence[int], int]]) -> float:
        """Share of the template in the best chain of matches (where in the text, ends in the template, length) that are in order in both: each ends
        after the one before it, in the text and in the template, and adds those of its words that lie after the end of the one before in the template."""
        size = self.sizes[template]
        best = np.zeros(size, dtype=np.int64)  # of the chains of the matches so far, by the template position of their last end
        gain = best - np.arange(size)  # what an overlapping match adds its own end to
        for _, ends, length in matches:
            found = []
            for end in ends:
                begin = end - length + 1
                value = length + (int(best[:begin].max()) if begin > 0 else 0)  # after chains that end before this match
                if length > 1:  # after chains that end within this match
                    value = max(value, int(gain[max(begin, 0) : end].max()) + end)
                found.append(value)
            for end, value in zip(ends, found):  # one match stands in a chain once
                if value > best[end]:
                    best[end], gain[end] = value, value - end
        return min(1.0, int(best.max()) / size)


def scan_licences(
    docs: DataFrame, phrases: dict[str, str] | None = None, templates: Sequence[tuple[str, str]] | None = None, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER
) -> DataFrame:
    """Per document: words, places of marker phrases (all of them, with the smallest and largest first word), the
    phrases' labels, all labels, and the best cover of any phrase or template as score."""
    phrases = PHRASES if phrases is None else phrases
    templates = read_templates() if templates is None else list(templates)

    def run(batches):
        scanner = Scanner(phrases, templates, min_match, min_cover)
        get = {w.encode(): i for w, i in scanner.ids.items()}.get
        for batch in batches:
            rows = []
            data, offsets = common.flat(batch.column(1))
            for first, end, part, at in common.slices(common.lowered(data), offsets):
                starts, stops, begin = common.words(part, at, alnum=True)
                raw = part.tobytes()
                ids = np.fromiter((get(raw[a:b], -1) for a, b in zip(starts.tolist(), stops.tolist())), dtype=np.int64, count=len(starts))
                for row in range(end - first):
                    places, covers = scanner.scan(ids[begin[row] : begin[row + 1]])
                    base = {scanner.labels[k] for _, k in places}
                    more = {scanner.labels[t] for t, c in covers.items() if c >= min_cover}
                    at_words = [p for p, _ in places]
                    rows.append((
                        int(begin[row + 1] - begin[row]), len(places), min(at_words, default=None), max(at_words, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else max(covers.values(), default=0.0),
                    ))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    return common.arrow(common.with_key(docs), run, f"doc_id long, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
