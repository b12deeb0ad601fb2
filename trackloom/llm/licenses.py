"""License scans: a generalised suffix automaton of licence tokens gives matching statistics for each
text; long matches are chained into covered spans of a template.

Runs inside the tasks that read the documents, without a shuffle; the automaton is built once per
task from the templates, a list of any length that the tasks are given. Null and empty texts give a row without spans. Rows are
independent of each other, so repeated ids and null ids give one row for each input row."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm import _text
from trackloom.llm.automaton import SuffixAutomaton
from trackloom.llm.license_texts import FULL_TEXTS, NOTICES

#: Phrases that count wherever their words stand consecutively, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Templates that texts are held against: notices, and whole texts.
TEMPLATES = {label: [*NOTICES.get(label, []), *([FULL_TEXTS[label]] if label in FULL_TEXTS else [])] for label in [*NOTICES, *FULL_TEXTS]}


def tokens_of(text: str) -> list[bytes]:
    """Words of a text; only A-Z are lower-cased."""
    return _WORD.findall(text.encode().lower())

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>,"
    " spans array<struct<label:string,start:long,end:long,covered:long,share:double>>"
)
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))]
)


class TemplateIndex:
    """The automaton of all templates and base phrases, and what its states mean."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], min_match: int, max_gap: int, min_share: float):
        self.min_match, self.max_gap, self.min_share = min_match, max_gap, min_share
        words = sorted({w for texts in [*templates.values(), phrases] for t in texts for w in tokens_of(t)})
        self.token = {w: k for k, w in enumerate(words)}
        self.templates = [(label, [self.token[w] for w in tokens_of(t)]) for label, texts in templates.items() for t in texts]
        of_phrase = [([self.token[w] for w in tokens_of(t)], label) for t, label in phrases.items()]
        sequences = [t for _, t in self.templates] + [t for t, _ in of_phrase]
        self.automaton = SuffixAutomaton(sequences)
        #: The templates that contain a state's strings, as bits of integers of any length.
        self.holders = [0] * len(self.automaton.link)
        place = iter(self.automaton.states)
        for k, tokens in enumerate(sequences):
            for _ in tokens:
                state = next(place)
                self.holders[state] |= 1 << k if k < len(self.templates) else 0
        for v in sorted(range(1, len(self.holders)), key=self.automaton.length.__getitem__, reverse=True):
            self.holders[self.automaton.link[v]] |= self.holders[v]
        ends: dict[int, list[tuple[int, str]]] = {}
        for tokens, label in of_phrase:
            state = matched = 0
            for token in tokens:
                state, matched = self.automaton.step(state, matched, token)
            ends.setdefault(state, []).append((len(tokens), label))
        #: Base phrases that end wherever a state (or one above it by suffix links) is reached.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.link]
        for v in sorted(range(len(self.phrases)), key=self.automaton.length.__getitem__):
            up = self.automaton.link[v]
            self.phrases[v] = ends.get(v, []) + (self.phrases[up] if up > 0 else [])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[dict]]:
        """(start, label) of base phrases, and chained template spans."""
        base: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # start, end, templates
        state = matched = 0
        at_before = -2
        step, phrases, value = self.automaton.step, self.phrases, self.holders
        get = self.token.get
        for at, token in enumerate(map(get, words)):
            if token is None:
                continue
            if at != at_before + 1:
                if matched >= self.min_match:
                    matches.append((at_before - matched + 1, at_before + 1, value[state]))
                state = matched = 0
            before, held = matched, state
            state, matched = step(state, matched, token)
            if matched != before + 1 and before >= self.min_match:
                matches.append((at - before, at, value[held]))
            for size, label in phrases[state]:
                if matched >= size:
                    base.append((at - size + 1, label))
            at_before = at
        if matched >= self.min_match:
            matches.append((at_before - matched + 1, at_before + 1, value[state]))
        return base, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Matches of one template with at most max_gap words between them make a span; it counts
        from min_share of the template's words."""
        spans = []
        open_: dict[int, list[int]] = {}

        def close(k: int) -> None:
            label, tokens = self.templates[k]
            start, end, covered = open_.pop(k)
            share = min(1.0, covered / len(tokens))
            if share >= self.min_share:
                spans.append({"label": label, "start": start, "end": end, "covered": covered, "share": share})

        for start, end, mask in matches:
            for k in [k for k, x in open_.items() if start - x[1] > self.max_gap]:
                close(k)
            while mask:
                k = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if k in open_:
                    held = open_[k]
                    held[2] += end - max(start, held[1])
                    held[1] = end
                else:
                    open_[k] = [start, end, end - start]
        for k in list(open_):
            close(k)
        return sorted(spans, key=lambda s: (s["start"], s["end"], s["label"], s["covered"]))


def scan_licenses(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = 3,
    max_gap: int = 6,
    min_share: float = 0.6,
) -> DataFrame:
    """One row for each document: its word count, the places of base phrases, and the spans of
    licence templates (words from 0, end exclusive). See the module for edge cases."""
    given = (templates or TEMPLATES, phrases or BASE_PHRASES, min_match, max_gap, min_share)
    built: list[TemplateIndex] = []

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        if not built:
            built.append(TemplateIndex(*given))
        out: dict[str, list] = {c: [] for c in _ARROW.names}
        out["doc_id"] = batch.column("doc_id").to_pylist()
        for text in _text.as_bytes(batch.column("text")):
            words = _WORD.findall(text.lower())
            base, spans = built[0].scan(words)
            starts = [s for s, _ in base]
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(sorted({label for _, label in base}))
            out["spans"].append(spans)
        return out

    return _text.map_texts(_text.texts_of(documents, id_col, text_col), kernel, SCHEMA, _ARROW)
