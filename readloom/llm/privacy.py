"""Personal information in free text, found by a skip-chain conditional random field.

Grammars propose overlapping candidate spans with a kind, a shape and the
label words before them.  The tokens inside candidates are the nodes of a
random field per document; all other tokens can only be outside, so they cut
the chain and need no node.  Neighbouring tokens are linked, and so are distant
repetitions of a token (or of its stem) in a document, whose labels then
support each other.  Loopy sum-product message passing over whole batches of
documents gives the label marginals, from which spans are decoded; a span must
agree with a candidate of its kind, which fixes its exact borders.

The weights are fitted by pseudo-likelihood with a Gaussian prior on at most
``train_docs`` documents, chosen by hash, that are labelled by rules of high
precision.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TRAIN_DOCS = 4000
#: The name lists are broadcast; they may have this many entries.
MAX_NAMES = 500_000
ROUNDS = 10

_L = r"[^\W\d_]"
_S = r"(?:[ \t\u00a0\u2009\u202f]{1,3}|[ ]?\n(?:> ?)?)"
_D = r"[ \t\u00a0\u2009\u202f]?"
_AT = rf"(?:{_D}@{_D}|{_D}[\[({{<]{_D}(?i:at|ät|arroba|chez|snabel-a){_D}[\])}}>]{_D})"
_DOT = rf"(?:\.|{_D}[\[({{<]{_D}(?i:dot|punkt|point|punto){_D}[\])}}>]{_D})"
_FROM = r"(?<![\w])(?<![\w][.\-/:])(?<!\+)"
_TO = r"(?![\w])(?![.\-/:]\w)"
_CAP = rf"(?-i:(?=[^\W\d_a-zß-öø-ÿ])){_L}+(?:[-'’]{_L}+)*"

_STREET_EN = "Street|St\\.|Road|Rd\\.?|Avenue|Ave\\.?|Lane|Ln\\.?|Row|Drive|Dr\\.|Close|Square|Court|Place|Terrace|Gardens|Crescent|Boulevard|Blvd\\.?|Alley|Mews"
_STREET_FR = "rue|quai|avenue|boulevard|place|chemin|allée|cours|impasse|route|passage|square"
_STREET_ES = "Calle|C/|Plaza|Avenida|Avda\\.|Paseo|Camino|Ronda|Travesía|Carretera"
_SUPPLEMENT = r"(?:[A-Za-z](?!\w)|[ \u00a0](?-i:[A-H])(?!\w))?"

GRAMMARS: tuple[tuple[str, str, re.Pattern], ...] = tuple(
    (kind, shape, re.compile(pattern, flags))
    for kind, shape, pattern, flags in (
        ("email", "mail", rf"(?<![\w.+\-])[\w.+\-]*\w{_AT}[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}{_L}{{2,}}(?![\w\-])", 0),
        ("phone", "plus", rf"(?<!\w)\+\d{{1,3}}(?:[ .\- ]?(?:\(\d+\)|\d+)){{1,7}}{_TO}", 0),
        ("phone", "zeros", rf"{_FROM}00[1-9]\d(?:[ .\-\u00a0]\d+){{1,6}}{_TO}", 0),
        ("phone", "paren", rf"(?<!\w)\(\d{{2,5}}\)[ \u00a0]?\d{{3,}}(?:[ \-\u00a0]\d+)*{_TO}", 0),
        ("phone", "trunk", rf"{_FROM}0\d{{1,4}}(?:[ .\-/\u00a0]\d{{2,8}}){{1,5}}{_TO}", 0),
        ("phone", "trunk_run", rf"{_FROM}0[1-9]\d{{7,9}}{_TO}", 0),
        ("phone", "ten", rf"{_FROM}(?:1[\-. ])?\d{{3}}[\-. ]\d{{3}}[\-. ]\d{{4}}{_TO}", 0),
        ("phone", "seven", rf"{_FROM}\d{{3}}-\d{{4}}{_TO}", 0),
        ("phone", "nine", rf"{_FROM}[6-9]\d\d(?:(?:[ \-.\u00a0]\d\d){{3}}|[ \-.\u00a0]\d{{3}}[ \-.\u00a0]\d{{3}}|\d{{6}}){_TO}", 0),
        ("id_number", "letters", rf"{_FROM}[A-Z]{{2}}{_D}\d\d{_D}\d\d{_D}\d\d{_D}[A-D]{_TO}", 0),
        ("id_number", "three_two_four", rf"{_FROM}\d{{3}}-\d\d-\d{{4}}{_TO}", 0),
        ("id_number", "eleven", rf"{_FROM}(?:\d\d[ \u00a0]\d{{3}}[ \u00a0]\d{{3}}[ \u00a0]\d{{3}}|\d{{11}}){_TO}", 0),
        ("id_number", "eight_letter", rf"{_FROM}(?:\d{{8}}|[XYZ]-?\d{{7}})-?[A-Z]{_TO}", 0),
        ("id_number", "fifteen", rf"{_FROM}(?:\d[ \u00a0]\d\d[ \u00a0]\d\d[ \u00a0]\d[\dAB][ \u00a0]\d{{3}}[ \u00a0]\d{{3}}(?:[ \u00a0]\d\d)?|\d{{15}}|\d{{13}}){_TO}", 0),
        ("id_number", "birth_four", rf"{_FROM}(?:\d\d)?\d{{6}}[\-+]\d{{4}}{_TO}", 0),
        ("id_number", "birth_sign", rf"{_FROM}\d{{6}}[\-+A]\d{{3}}[0-9A-Y]{_TO}", 0),
        ("id_number", "birth_run", rf"{_FROM}(?:19|20)?\d{{10}}{_TO}", 0),
        ("address", "en", rf"{_FROM}\d{{1,4}}[A-Za-z]?{_S}(?:(?:Old|New|Upper|Lower|North|South|East|West|Great|Little){_S})?{_CAP}{_S}(?:{_STREET_EN})(?!\w)", re.I),
        ("address", "fr", rf"{_FROM}\d{{1,4}}(?:{_S}?(?:bis|ter|quater|[A-D](?!\w)))?,?{_S}(?:{_STREET_FR}){_S}(?:(?:de|du|des|de{_S}la){_S}|d['’]|de{_S}l['’])?{_CAP}", re.I),
        ("address", "es", rf"(?<!\w)(?:{_STREET_ES}){_S}?(?:(?:de|del|de{_S}la|de{_S}los){_S})?{_CAP}(?:{_S}{_CAP})?,?{_S}(?:n[.ºo°]*{_S}?)?\d{{1,4}}{_SUPPLEMENT}(?!\w)", re.I),
        ("address", "de", rf"(?<!\w){_L}+(?:str\.|straße|strasse|weg|gasse|allee|platz){_S}\d{{1,4}}{_SUPPLEMENT}(?!\w)", re.I),
        ("address", "de_weak", rf"(?<!\w){_L}+(?:ring|ufer|damm|wall|graben|stieg){_S}\d{{1,4}}{_SUPPLEMENT}(?!\w)", re.I),
        ("address", "de_am", rf"(?<!\w)(?:Am|An{_S}der|Im|In{_S}der|Zum|Zur|Auf{_S}dem){_S}{_CAP}{_S}\d{{1,4}}{_SUPPLEMENT}(?!\w)", 0),
        ("address", "sv", rf"(?<!\w){_L}+(?:gatan|vägen|gränden|stigen|allén){_S}\d{{1,4}}{_SUPPLEMENT}(?!\w)", re.I),
        ("address", "sv_torg", rf"(?<!\w){_CAP}{_S}(?:torg|gata|väg|gränd){_S}\d{{1,4}}{_SUPPLEMENT}(?!\w)", re.I),
    )
)

#: A grammar of numbers matches within runs of at least six digits with at most three other characters between two.
_DIGIT_RUN = re.compile(r"\d(?:\D{0,3}\d)*")
_LEAST_DIGITS = 6
#: Room for a sign, bracket or letters at either end of such a run.
_MARGIN = 8
_WRITTEN_AT = re.compile(r"[\[({<][ \t\u00a0\u2009\u202f]?(?i:at|ät|arroba|chez|snabel-a)")
#: Parts of which an address of that shape has one at least, in lower case.
_STREET_PARTS = {
    "fr": tuple(_STREET_FR.split("|")),
    "es": tuple(w.lower().replace("\\", "") for w in _STREET_ES.split("|")),
    "de": ("str.", "straße", "strasse", "weg", "gasse", "allee", "platz"),
    "de_weak": ("ring", "ufer", "damm", "wall", "graben", "stieg"),
    "sv": ("gatan", "vägen", "gränden", "stigen", "allén"),
    "sv_torg": ("torg", "gata", "väg", "gränd"),
}

#: Words that announce what follows; the last ones before a candidate count.
CUES = {
    "phone": "tel tél telefon teléfono telephone téléphone phone mobile mobil handy móvil fax ring call le".split(),
    "id": "id identity national number ausweis ausweisnr nr steuer dni nie documento sécu pièce identité identite "
    "personnr personnummer legitimation passport ssn nino insurance n".split(),
    "address": "address anschrift adresse dirección direccion adress wohnhaft domicilié domiciliée domicilio bosatt at".split(),
    "mail": "mail email e".split(),
    "thing": "lot catalogue cat katalog plate order rack ratio version tag index chr batch charge".split(),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}
_WORD = re.compile(rf"{_L}+")
_DIGITS = re.compile(r"\d")
_TOKEN = re.compile(rf"{_L}+|\d+|[^\s\w]|_")
_NAME_WORD = re.compile(rf"{_L}+(?:['’]{_L}+)*")
_INITIALS = re.compile(rf"(?:{_L}\.{_D}){{1,3}}\Z")
_GAP = re.compile(rf"{_S}\Z")


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str
    shape: str
    cue: str


def _cue(text: str, start: int) -> str:
    before = text[max(0, start - 32) : start]
    if (cut := max(before.rfind("\n\n"), before.rfind("; "), before.rfind("! "), before.rfind("? "))) >= 0:
        before = before[cut:]
    before = _DIGITS.split(before)[-1]  # what stood before another number announced that one
    words = [w.lower() for w in _WORD.findall(before)][-3:]
    for w in reversed(words):
        if w in _CUE and not (w in ("e", "n", "at", "le") and w != words[-1]):
            return _CUE[w]
    return "none"


class NameFinder:
    """Name candidates from lists of given and family names, compared without case."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family

    def find(self, text: str) -> Iterator[tuple[int, int, str]]:
        words = list(_NAME_WORD.finditer(text))
        lower = [m.group().lower() for m in words]
        for i, w in enumerate(lower):
            if w not in self.family or not words[i].group()[0].isupper():
                continue
            if i and text[words[i - 1].end() : words[i].start()] == "-" and lower[i - 1] in self.family:
                continue  # second part of a double name
            start, last = words[i].start(), i
            while last + 1 < len(words) and text[words[last].end() : words[last + 1].start()] == "-" and words[last + 1].group()[0].isupper():
                last += 1
            end = words[last].end()
            head = text[max(0, start - 40) : start]
            # initials directly before, then perhaps a given name before those
            initials = 0
            j = i
            while j > 0 and len(lower[j - 1]) == 1 and words[j - 1].group().isupper():
                between = text[words[j - 1].end() : words[j].start()]
                if not (between[:1] == "." and (between == "." or _GAP.match(between[1:]))):
                    break
                j -= 1
                initials += 1
            if j > 0 and lower[j - 1] in self.given and words[j - 1].group()[0].isupper() and _GAP.match(text[words[j - 1].end() : words[j].start()]):
                g = j - 1
                if g > 0 and text[words[g - 1].end() : words[g].start()] == "-" and lower[g - 1] in self.given:
                    g -= 1
                yield words[g].start(), end, "given_initial" if initials else "given"
                continue
            if initials and head:
                yield words[j].start(), end, "initials"
                continue
            after = text[end : end + 40]
            if (m := re.match(rf",{_S}", after)) and last + 1 < len(words) and words[last + 1].start() == end + m.end():
                g = last + 1
                if lower[g] in self.given and words[g].group()[0].isupper():
                    stop = words[g].end()
                    # "Family, Given" unless that given name begins a name of its own
                    follows = g + 1 < len(words) and lower[g + 1] in self.family and _GAP.match(text[stop : words[g + 1].start()])
                    if not follows:
                        yield start, stop, "turned"
                        continue
                if m2 := re.match(rf"(?:{_L}\.{_D}){{1,3}}(?!{_L})", text[words[g].start() : words[g].start() + 12]):
                    stop = words[g].start() + len(m2.group().rstrip())
                    nxt = next((k for k in range(g, min(g + 4, len(words))) if len(lower[k]) > 1), None)
                    owns = nxt is not None and lower[nxt] in self.family and words[nxt].start() <= stop + 2
                    if words[g].group().isupper() and not owns:
                        yield start, stop, "turned_initials"
                        continue
            yield start, end, "family_only"


def _number_regions(text: str) -> list[tuple[int, int]]:
    """Where numbers of six digits or more may be, with margins that end at the digits before and behind."""
    runs = [m.span() for m in _DIGIT_RUN.finditer(text)]
    regions = []
    for i, (start, end) in enumerate(runs):
        if end - start >= _LEAST_DIGITS and sum(c.isdigit() for c in text[start:end]) >= _LEAST_DIGITS:
            before = runs[i - 1][1] if i else 0
            behind = runs[i + 1][0] if i + 1 < len(runs) else len(text)
            regions.append((max(before, start - _MARGIN), min(behind, end + _MARGIN)))
    return regions


def _matches(text: str) -> Iterator[tuple[str, str, re.Match]]:
    """All matches of the grammars; each is tried only where a cheap test leaves room for it."""
    has_digit = any(c.isdigit() for c in text)
    regions = _number_regions(text) if has_digit else []
    # letters that match others without case, but are not their lower case
    lower = text.lower().replace("ſ", "s").replace("ı", "i") if has_digit else ""
    for kind, shape, pattern in GRAMMARS:
        if kind == "email":
            if "@" in text or _WRITTEN_AT.search(text):
                yield from ((kind, shape, m) for m in pattern.finditer(text))
        elif kind == "address":
            parts = _STREET_PARTS.get(shape)
            if has_digit and (parts is None or any(p in lower for p in parts)):
                yield from ((kind, shape, m) for m in pattern.finditer(text))
        else:
            for start, end in regions:
                yield from ((kind, shape, m) for m in pattern.finditer(text, start, end))


def _apart(ordered: Iterable[Candidate]) -> list[Candidate]:
    """Greedily those that overlap none taken before."""
    starts: list[int] = []
    taken: list[Candidate] = []
    for c in ordered:
        i = bisect_left(starts, c.start)
        before = i == 0 or taken[i - 1].end <= c.start
        if before and (i == len(starts) or c.end <= starts[i]):
            starts.insert(i, c.start)
            taken.insert(i, c)
    return taken


def candidates(text: str, names: NameFinder) -> list[Candidate]:
    """All candidate spans in order; of one kind, the longer of two overlapping ones stays."""
    found: list[Candidate] = []
    for kind, shape, m in _matches(text):
        if kind == "phone" and not 7 <= sum(c.isdigit() for c in m.group()) <= 15:
            continue
        found.append(Candidate(m.start(), m.end(), kind, shape, _cue(text, m.start())))
    for start, end, shape in names.find(text):
        found.append(Candidate(start, end, "name", shape, _cue(text, start)))
    by_kind: dict[str, list[Candidate]] = {}
    for c in found:
        by_kind.setdefault(c.kind, []).append(c)
    kept = [c for kind in sorted(by_kind) for c in _apart(sorted(by_kind[kind], key=lambda c: (c.start - c.end, c.start)))]
    # of equal spans the kinds come in order, and of one kind the shape listed first
    return sorted(kept, key=lambda c: (c.start, c.end))


def rule_accepts(c: Candidate, others: list[Candidate]) -> bool:
    """The high-precision labels that the field is fitted on."""
    if c.kind == "email":
        return True
    if any(o.kind == "email" and o.start < c.end and c.start < o.end for o in others):
        return False
    if c.kind == "name":
        return c.shape != "family_only"
    if c.kind == "address":
        return c.shape != "de_weak" or c.cue == "address"
    if c.cue == "thing":
        return False
    rival = [o for o in others if o is not c and {o.kind, c.kind} == {"phone", "id_number"} and o.start < c.end and c.start < o.end]
    if c.kind == "id_number":
        if c.shape == "birth_run":
            return c.cue == "id"
        return not rival or c.cue != "phone"
    if not rival:
        return c.cue != "id"
    return c.cue == "phone" or (rival[0].shape == "birth_run" and c.cue != "id")


@dataclass
class Nodes:
    """Tokens inside candidates, of many documents."""

    doc: list[int]
    start: list[int]
    end: list[int]
    features: list[list[str]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    spans: list[list[tuple[Candidate, int, int]]]  # per document: candidate, first and last node + 1


def build_nodes(texts: list[str | None], names: NameFinder) -> Nodes:
    n = Nodes([], [], [], [], [], [], [])
    for d, text in enumerate(texts):
        spans: list[tuple[Candidate, int, int]] = []
        n.spans.append(spans)
        cands = candidates(text, names) if isinstance(text, str) and text else []
        if not cands:
            continue
        regions: list[list[Candidate]] = []
        reach = -1
        for c in cands:
            if c.start < reach:
                regions[-1].append(c)
            else:
                regions.append([c])
            reach = max(reach, c.end)
        last_of: dict[str, int] = {}
        for region in regions:
            first = len(n.doc)
            lo, hi = region[0].start, max(c.end for c in region)
            tokens = list(_TOKEN.finditer(text, lo, hi))
            for t in tokens:
                node = len(n.doc)
                if node > first:
                    n.chain.append((node - 1, node))
                feats, mail = ["bias"], False
                for c in region:
                    if c.start <= t.start() and t.end() <= c.end:
                        at = "B" if t.start() == c.start else "I"
                        mail |= c.kind == "email"
                        feats += [f"k={c.kind}:{at}", f"s={c.kind}/{c.shape}:{at}", f"c={c.kind}/{c.cue}:{at}", f"sc={c.kind}/{c.shape}/{c.cue}:{at}"]
                w = t.group().lower()
                feats.append("t=" + ("digits" if w.isdigit() else "word" if w.isalpha() else w))
                if w in names.family:
                    feats.append("family")
                if w in names.given:
                    feats.append("given")
                n.doc.append(d)
                n.start.append(t.start())
                n.end.append(t.end())
                n.features.append(feats)
                # repeated or similar tokens: the same number, or words with the same stem
                key = w if w.isdigit() and len(w) > 3 else w[:6] if w.isalpha() and len(w) > 3 else ""
                if key and not mail:
                    if key in last_of:
                        n.skip.append((last_of[key], node))
                    last_of[key] = node
            for c in region:
                inside = [first + i for i, t in enumerate(tokens) if c.start <= t.start() and t.end() <= c.end]
                if inside:
                    spans.append((c, inside[0], inside[-1] + 1))
    return n


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    def scores(self, nodes: Nodes) -> np.ndarray:
        out = np.zeros((len(nodes.doc), len(LABELS)))
        flat = [(i, self.features[f]) for i, fs in enumerate(nodes.features) for f in fs if f in self.features]
        if flat:
            rows, cols = np.array(flat).T
            np.add.at(out, rows, self.weights[cols])
        # kinds without a candidate at a token are impossible there; known from its features
        allowed = np.zeros_like(out, bool)
        allowed[:, 0] = True
        for i, fs in enumerate(nodes.features):
            for f in fs:
                if f.startswith("k="):
                    k = KINDS.index(f[2:-2])
                    allowed[i, 1 + 2 * k : 3 + 2 * k] = True
        out[~allowed] = -30.0
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def marginals(model: Model, nodes: Nodes, rounds: int = ROUNDS) -> np.ndarray:
    """Log marginals by loopy sum-product, all documents of the batch at once."""
    theta = model.scores(nodes)
    edges = [*nodes.chain, *nodes.skip]
    if not edges:
        return _normal(theta)
    a, b = np.array(edges).T
    is_skip = np.arange(len(edges)) >= len(nodes.chain)
    # both directions: source, target, and the matrix read as [source label, target label]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    forward = np.where(is_skip[:, None, None], model.skip[None], model.chain[None])
    pair = np.exp(np.concatenate([forward, forward.transpose(0, 2, 1)]))
    twin = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    messages = np.zeros((len(src), len(LABELS)))
    for _ in range(rounds):
        incoming = theta.copy()
        np.add.at(incoming, dst, messages)
        out = incoming[src] - messages[twin]
        out -= out.max(axis=1, keepdims=True)
        messages = _normal(np.log(np.einsum("el,elm->em", np.exp(out), pair) + 1e-300))
    belief = theta.copy()
    np.add.at(belief, dst, messages)
    return _normal(belief)


def decode(nodes: Nodes, belief: np.ndarray) -> list[list[Candidate]]:
    """Accepted candidates per document: those whose tokens carry their kind, from a beginning on."""
    label = belief.argmax(axis=1) if len(belief) else np.zeros(0, int)
    kind_of = (label + 1) // 2  # 0 outside, 1.. kinds
    out: list[list[Candidate]] = []
    for spans in nodes.spans:
        taken: list[tuple[float, Candidate]] = []
        for c, lo, hi in spans:
            share = float((kind_of[lo:hi] == KINDS.index(c.kind) + 1).mean())
            if share > 0.5 and kind_of[lo] == KINDS.index(c.kind) + 1:
                taken.append((share, c))
        taken.sort(key=lambda x: (-x[0], x[1].start - x[1].end, x[1].start))
        out.append(_apart(c for _, c in taken))
    return out


def _gold(nodes: Nodes) -> np.ndarray:
    gold = np.zeros(len(nodes.doc), int)
    for spans in nodes.spans:
        region: list[tuple[Candidate, int, int]] = []
        reach = -1
        for span in [*spans, None]:  # rules look at candidates of one region only: the others overlap none of them
            if span is None or span[0].start >= reach:
                cands = [c for c, _, _ in region]
                for c, lo, hi in region:
                    if rule_accepts(c, cands):
                        k = 1 + 2 * KINDS.index(c.kind)
                        gold[lo], gold[lo + 1 : hi] = k, k + 1
                region = []
            if span is not None:
                region.append(span)
                reach = max(reach, span[0].end)
    return gold


def fit(texts: list[str], names: NameFinder, steps: int = 150, max_nodes: int = 12_000) -> Model:
    """Pseudo-likelihood with a prior that trusts each grammar a little; documents beyond ``max_nodes`` tokens are not used."""
    nodes = build_nodes(texts, names)
    if len(nodes.doc) > max_nodes:
        stop = nodes.doc[max_nodes]
        nodes = build_nodes(texts[:stop], names)
    gold = _gold(nodes)
    index: dict[str, int] = {}
    for kind in KINDS:
        for at in "BI":
            index[f"k={kind}:{at}"] = len(index)
            index[f"c={kind}/thing:{at}"] = len(index)
    for at in "BI":
        index[f"s=name/family_only:{at}"] = len(index)
        index[f"s=address/de_weak:{at}"] = len(index)
    for fs in nodes.features:
        for f in fs:
            index.setdefault(f, len(index))
    n, labels = len(nodes.doc), len(LABELS)
    prior = np.zeros((len(index), labels))
    for k, kind in enumerate(KINDS):
        prior[index[f"k={kind}:B"], 1 + 2 * k] = 3.0
        prior[index[f"k={kind}:I"], 2 + 2 * k] = 3.0
    for f, i in index.items():
        if f.startswith(("s=name/family_only", "s=address/de_weak")):
            prior[i, 0] = 6.0
        elif f.startswith("c=") and "/thing:" in f:
            prior[i, 0] = 3.0
    chain0 = np.zeros((labels, labels))
    for k in range(len(KINDS)):
        chain0[1 + 2 * k, 2 + 2 * k] = chain0[2 + 2 * k, 2 + 2 * k] = 1.5
        chain0[[j for j in range(labels) if (j + 1) // 2 != k + 1], 2 + 2 * k] = -3.0
    skip0 = np.zeros((labels, labels))
    for j in range(1, labels):
        for i in range(1, labels):
            if (i + 1) // 2 == (j + 1) // 2:
                skip0[i, j] = 0.5
    model = Model(index, prior.copy(), chain0.copy(), skip0.copy())
    if n == 0:
        return model
    x = np.zeros((n, len(index)), np.float32)
    for i, fs in enumerate(nodes.features):
        x[i, [index[f] for f in fs]] = 1
    eye = np.eye(labels)
    left, right = (np.array(nodes.chain, int).reshape(-1, 2)).T
    first, second = (np.array(nodes.skip, int).reshape(-1, 2)).T
    blocked = model.scores(nodes) <= -29.0
    params = [model.weights, model.chain, model.skip]
    priors = [prior, chain0, skip0]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        s = x @ model.weights
        np.add.at(s, right, model.chain[gold[left]])
        np.add.at(s, left, model.chain[:, gold[right]].T)
        np.add.at(s, second, model.skip[gold[first]])
        np.add.at(s, first, model.skip[:, gold[second]].T)
        s[blocked] = -30.0
        error = np.exp(_normal(s)) - eye[gold]
        error[blocked] = 0.0
        grads = [x.T @ error, np.zeros_like(chain0), np.zeros_like(skip0)]
        np.add.at(grads[1], gold[left], error[right])
        np.add.at(grads[1].T, gold[right], error[left])
        np.add.at(grads[2], gold[first], error[second])
        np.add.at(grads[2].T, gold[second], error[first])
        for p, p0, g, (m, v) in zip(params, priors, grads, moments):
            g = g + 0.5 * (p - p0)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.skip = (model.skip + model.skip.T) / 2
    return model


def _finder(names: DataFrame, part: str, text: str) -> NameFinder:
    rows = names.select(F.col(f"`{part}`").alias("p"), F.col(f"`{text}`").alias("n")).where("p is not null and n is not null").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} known names: they are broadcast to every task")
    given = {r.n.lower() for r in rows if r.p == "given"}
    return NameFinder(given, {r.n.lower() for r in rows if r.p == "family"})


def _sample(docs: DataFrame, train_docs: int) -> list[str]:
    """Texts of the ``train_docs`` documents with the least hashes.

    A bound that a few more hashes than wanted stay below is taken from the number of documents, so that only ids
    near the front are put in order, and texts only of those chosen are sent.
    """
    known = docs.where("text is not null").withColumn("h", F.xxhash64("doc"))
    whole = known.count()
    near = known
    if whole > 2 * train_docs:
        share = (train_docs + 6 * train_docs**0.5 + 50) / whole
        near = known.where(F.col("h") < int(-(2**63) + min(1.0, share) * 2**64))
    ids = near.select("h", "doc").orderBy("h", "doc").limit(train_docs)
    picked = ids.collect()
    if len(picked) < min(train_docs, whole):  # repeated ids share a hash: the bound may hold too few
        near, picked = known, known.select("h", "doc").orderBy("h", "doc").limit(train_docs).collect()
    if not picked:
        return []
    last = picked[-1].h
    rows = near.where(F.col("h") <= last).orderBy("h", "doc").limit(train_docs).select("text").collect()
    return [r.text for r in rows]


def detect(model: Model, names: NameFinder, texts: list[str | None]) -> list[list[Candidate]]:
    nodes = build_nodes(texts, names)
    return decode(nodes, marginals(model, nodes)) if nodes.doc else [[] for _ in texts]


def _prepared(docs: DataFrame, names: DataFrame, doc_id: str, text: str, train_docs: int):
    source = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    finder = _finder(names, "name_part", "name_text")
    model = fit(_sample(source, train_docs), finder)
    return source, finder, model


def _chunks(batch: pd.DataFrame, size: int = 1000) -> Iterator[pd.DataFrame]:
    for i in range(0, len(batch), size):
        yield batch.iloc[i : i + size]


def find_personal(
    docs: DataFrame, names: DataFrame, *, doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS
) -> DataFrame:
    """doc_id, kind, found: every different piece of personal information of each document, as written.

    One narrow pass over whole texts; the fitted weights and the name lists
    travel with the task.

    Defined results: null and empty texts have none; a piece written twice in
    a document is reported once, differently written pieces each; repeated
    documents give the same rows under their own ids; an empty table gives an
    empty result.  Further columns are not read.
    """
    source, finder, model = _prepared(docs, names, doc_id, text, train_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for batch in _chunks(whole):
                texts = batch["text"].tolist()
                rows = [
                    (doc, kind, found)
                    for doc, t, cs in zip(batch["doc"].tolist(), texts, detect(model, finder, texts))
                    for kind, found in dict.fromkeys((c.kind, t[c.start : c.end]) for c in cs)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "kind", "found"])

    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, kind string, found string")


def redact(text: str, found: list[Candidate]) -> str:
    out, at = [], 0
    for c in found:
        out += [text[at : c.start], f"[{c.kind.upper()}]"]
        at = c.end
    return "".join([*out, text[at:]])


def redact_personal(
    docs: DataFrame, names: DataFrame, *, doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS
) -> DataFrame:
    """doc_id, redacted, replaced: each text with typed placeholders, otherwise unchanged.

    Defined results as in ``find_personal``; a null text stays null.
    """
    source, finder, model = _prepared(docs, names, doc_id, text, train_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for batch in _chunks(whole):
                texts = batch["text"].tolist()
                found = detect(model, finder, texts)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc"],
                        "redacted": pd.Series(
                            [redact(t, cs) if isinstance(t, str) else None for t, cs in zip(texts, found)], index=batch.index, dtype=object
                        ),
                        "replaced": pd.Series([len(cs) for cs in found], index=batch.index, dtype="int64"),
                    }
                )

    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, redacted string, replaced bigint")
