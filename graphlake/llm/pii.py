"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained on the driver from a small labelled table (sentences with
tagged words) and decoded by Viterbi in numpy, many word sequences at a time.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices, texts as texts_of
from .wordhash import _BYTE, _LOWER, Words, byte_ranges

# ---------------------------------------------------------------- fixed patterns

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the field adds, after the fixed ones in order.
FIELD_KINDS = ("name", "address", "national_id", "local_phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit run can only begin a match at its first digit, hence the look-behinds; they save rescans of long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, in order."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---------------------------------------------------------------- labelled table

#: What a span of each added kind must look like, whatever the field says.
FORMS = {
    "name": re.compile(r"[^\W\d_a-z][\w'-]+( [^\W\d_a-z]\.)?( [^\W\d_a-z][\w'-]+){1,2}"),
    "address": re.compile(r"[0-9]{1,5}[A-Za-z]?,?( [\w'-]+){1,3}( [\w'-]+\.?)"),
    "national_id": re.compile(r"[0-9]{2,4}([ .-][0-9]{2,4}){2,3}"),
    "local_phone": re.compile(r"\(?[0-9]{2,4}\)?([ .-]?[0-9]{3,6}){1,3}"),
}


def looks_like(kind: str, words: str) -> bool:
    return FORMS[kind].fullmatch(words) is not None and (kind != "name" or len(set(words.split())) > 1)


#: Sentences with tagged slots; fixed values.
TEMPLATES = (
    "My name is {name} and I live at {address} in Leeds.",
    "Please contact {title} {name} about the order.",
    "{title} {name} will see you on Monday.",
    "Signed, {name}",
    "Kind regards, {name}",
    "Patient name: {name}, born in 1970.",
    "The customer, {title} {name}, lives at {address}.",
    "Send it to {address}, please.",
    "Our office is at {address} near the station.",
    "Deliver to {name}, {address}.",
    "His social security number is {national_id} according to the form.",
    "SSN: {national_id}",
    "Employee SSN {national_id} ok",
    "The id of the holder, {national_id}, was checked.",
    "Her national id {national_id} was on file.",
    "Call me on {local_phone} after six.",
    "Phone: {local_phone}",
    "Tel. {local_phone} or write to the office.",
    "Please call {local_phone} now",
    "You can reach me on {local_phone} any time.",
    "Je m'appelle {name} et j'habite au {address} depuis mai.",
    "Mein Name ist {name} und meine Nummer ist {local_phone} hier.",
    "Me llamo {name} y vivo en {address} ahora.",
    "Madame {name} a appelé hier.",
    "Herr {name} ist nicht da.",
    "El señor {name} no vino.",
    "The weather in Paris is mild this week.",
    "In 1998 there were 1200 members and 35 clubs.",
    "This is London. That was The Times. It is Monday.",
    "The price rose from 12.50 to 13.75 in May 2019.",
    "On 12/05/2020 the House of Lords met at noon.",
    "Version 2.3.1 of the program was sold 4500 times.",
    "No. The. Of the and. Er is the onent. Thand inre Ofthe.",
    "He ran 100 metres in 11 seconds, then 200 in 24.",
    "Chapter 12 of the Green Book is about Main Street art.",
    "Le chat est dans la maison. Un jour, La France.",
    "Der Hund ist im Haus und die Katze schläft. Ein Tag.",
    "El perro está en la casa. Un día, La Paz.",
    "Total 555 items; see page 42, line 1234.",
    "The token is 24be64439e3e49 and the code 4455 6677.",
    "Anblewh sttible athawh thonre was is anly hend and, oftionnten.",
    "At nine the meeting on Monday is over. I live in Rome.",
)
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Mr", "Mrs", "Dr", "Prof.")
FIRST = ("John", "Mary", "Ahmed", "Wei", "Olga", "Pierre", "Anna", "Luis", "Ingrid", "Kofi", "Sara", "Tom", "Yuki", "Elena", "Hans", "Priya")
LAST = ("Smith", "Jones", "Garcia", "Müller", "Dubois", "Rossi", "Kowalski", "Tanaka", "Okafor", "Larsen", "O'Brien", "Novak", "Ivanova", "Chen")
STREETS = ("Baker", "High", "Church", "Mill", "Station", "Park", "Victoria", "Green", "London", "Queen")
STREET_KINDS = ("Street", "Road", "Avenue", "Lane", "Drive", "St.", "Rd.", "Ave.")


SYLLABLES = ("ba", "ren", "tio", "the", "lo", "mi", "sta", "kel", "or", "un", "ga", "dé", "vin", "ez", "sch", "ou")


def labelled_table(copies: int = 8, plain: int = 160, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Sentences as (word, tag) rows; tags are ``O``, ``B-kind`` and ``I-kind``.

    Some untagged words are replaced by made-up ones and ``plain`` sentences are made
    of such words alone, so that a word unknown to the field is no sign of a span.
    """
    draw = random.Random(seed)
    digits = lambda n: "".join(str(draw.randrange(10)) for _ in range(n))
    proper = lambda known: draw.choice(known) if draw.random() < 0.4 else "".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(2, 4))).capitalize()
    fill = {
        "title": lambda: draw.choice(TITLES),
        "name": lambda: " ".join([proper(FIRST), *([draw.choice("ABCDJKLM") + "."] if draw.random() < 0.2 else []), proper(LAST)]),
        "address": lambda: f"{draw.randrange(1, 400)} {proper(STREETS)} {draw.choice(STREET_KINDS)}",
        "national_id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "local_phone": lambda: draw.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(6)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
    }
    rows = []

    def made_up() -> str:
        word = "".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 5)))
        word = word.capitalize() if draw.random() < 0.2 else word.upper() if draw.random() < 0.02 else word
        return word + draw.choice(["", "", "", "", "", "", ",", ".", ";", "***"])

    for _ in range(plain):
        numbers = lambda: draw.choice([digits(draw.randrange(1, 9)), f"{digits(2)}.{digits(2)}", f"{digits(4)},"])
        rows.append([(numbers() if draw.random() < 0.06 else draw.choice(["at", "the", "of", "is", "in", "on", "de", "la"]) if draw.random() < 0.15 else made_up(), "O") for _ in range(draw.randrange(4, 22))])
    for n in range(plain // 4):
        # shouted lines, and one word again and again
        one = made_up()
        rows.append([(made_up().upper() + draw.choice(["", "!!"]) if n % 2 else one, "O") for _ in range(draw.randrange(4, 20))])
        cells = [x for _ in range(4) for x in ("|" if n % 3 else draw.choice("AIYEO") + draw.choice(["", "."]), made_up().capitalize())]
        rows.append([(x, "O") for x in cells])
    for template in TEMPLATES:
        for _ in range(copies):
            row = []
            for piece in re.split(r"(\{\w+\})", template):
                if piece[:1] == "{":
                    kind = piece[1:-1]
                    words = fill[kind]().split()
                    row += [(w, "O" if kind == "title" else ("B-" if i == 0 else "I-") + kind) for i, w in enumerate(words)]
                else:
                    glued = row and piece[:1] in ".,;:"
                    for i, w in enumerate(piece.split()):
                        if glued and i == 0:
                            row[-1] = (row[-1][0] + w, row[-1][1])
                        else:
                            row.append((made_up() if draw.random() < 0.12 else w, "O"))
            rows.append(row)
    return rows


# ---------------------------------------------------------------- word features

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b".,;:!?\"'()[]")] = True
_IS_UP = np.zeros(256, dtype=np.int32)
_IS_UP[65:91] = 1
_IS_LOW = np.zeros(256, dtype=np.int32)
_IS_LOW[97:123] = 1
_IS_LOW[128:] = 1
_IS_DIGIT = np.zeros(256, dtype=np.int32)
_IS_DIGIT[48:58] = 1
_IS_AT = np.zeros(256, dtype=np.int32)
_IS_AT[64] = 1
_PLAIN_SHAPES = 18


def _digit_shape(word: bytes) -> str:
    """Word shape of a word with digits: each digit d, letter runs x, other characters themselves."""
    text = word.decode("utf-8", "replace").strip(".,;:!?\"'")
    return re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]+", "x", text))[:24]


class Features:
    """Shape and identity of words, by numpy over a batch; identities only of the words of the training table."""

    def __init__(self, words: list[str]):
        self.shapes: dict[str, int] = {}
        column = pa.array([" ".join(words)])
        w = Words(column)
        for shape in sorted({_digit_shape(x.encode()) for x in words if re.search("[0-9]", x)}):
            self.shapes[shape] = _PLAIN_SHAPES + 1 + len(self.shapes)
        self.n_shapes = _PLAIN_SHAPES + 1 + len(self.shapes)
        core, _, _ = self._core(w)
        known, counts = np.unique(core, return_counts=True)
        self.known = known[counts >= 6]
        self.n_words = len(self.known) + 1

    @staticmethod
    def _core(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the lower-cased word without punctuation at its ends, and that core's byte range."""
        start, end = w.start.copy(), w.end.copy()
        for _ in range(3):
            start += (start < end) & _PUNCT[w.raw[np.minimum(start, len(w.raw) - 1)]] if len(w.raw) else 0
            end -= (start < end) & _PUNCT[w.raw[end - 1]] if len(w.raw) else 0
        return byte_ranges(_BYTE[_LOWER[w.raw]], start, end), start, end

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shape * n_words + identity, core start, core end) of each word."""
        core, start, end = self._core(w)
        count = lambda flags: (lambda c: c[w.end] - c[w.start])(np.concatenate([[0], np.cumsum(flags[w.raw], dtype=np.int32)]))
        up, low, digit, at = count(_IS_UP), count(_IS_LOW), count(_IS_DIGIT), count(_IS_AT)
        first_up = _IS_UP[w.raw[np.minimum(start, max(len(w.raw) - 1, 0))]] > 0 if len(w.raw) else np.zeros(0, bool)
        shape = np.select([at > 0, (up == 0) & (low > 0), first_up & (low > 0), up >= 2, up == 1], [5, 0, 1, 2, 3], 4)
        last = w.raw[w.end - 1] if len(w.raw) else np.zeros(0, np.uint8)
        tail = np.select([np.isin(last, list(b",;:")), np.isin(last, list(b".!?"))], [1, 2], 0)
        shape = shape * 3 + tail
        for i in np.flatnonzero(digit > 0).tolist():
            size = w.end[i] - w.start[i]
            shape[i] = self.shapes.get(_digit_shape(w.raw[w.start[i] : w.end[i]].tobytes()), _PLAIN_SHAPES) if size <= 40 else _PLAIN_SHAPES
        place = np.searchsorted(self.known, core)
        known = self.known[np.minimum(place, len(self.known) - 1)] == core if len(self.known) else np.zeros(len(core), bool)
        return shape * self.n_words + np.where(known, place + 1, 0), start, end


# ---------------------------------------------------------------- the field


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Linear-chain conditional random field: weights of word features at four offsets, and of tag pairs."""

    OFFSETS = (-2, -1, 0, 1)

    def __init__(self, rows: list[list[tuple[str, str]]], steps: int = 120, decay: float = 5e-5):
        self.tags = ["O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI")]
        place = {t: i for i, t in enumerate(self.tags)}
        self.features = Features([w for row in rows for w, _ in row])
        n_tags, longest = len(self.tags), max(map(len, rows))
        text = Words(pa.array([" ".join(w for w, _ in row) for row in rows]))
        codes, _, _ = self.features(text)
        self.edge = self.features.n_shapes * self.features.n_words  # the code beyond either end
        x = np.full((len(rows), longest + 3), self.edge)
        y = np.zeros((len(rows), longest), dtype=int)
        on = np.zeros((len(rows), longest), dtype=bool)
        for i, row in enumerate(rows):
            x[i, 2 : 2 + len(row)] = codes[text.first[i] : text.first[i + 1]]
            y[i, : len(row)] = [place[t] for _, t in row]
            on[i, : len(row)] = True
        v = self.features.n_words
        s, l = np.append(np.arange(self.edge) // v, self.features.n_shapes), np.append(np.arange(self.edge) % v, v)
        shapes = [np.zeros((self.features.n_shapes + 1, n_tags)) for _ in self.OFFSETS]
        words = [np.zeros((v + 1, n_tags)) for _ in self.OFFSETS]
        step = np.zeros((n_tags, n_tags))
        allowed = np.array([[not (b[0] == "I" and a[2:] != b[2:]) for b in self.tags] for a in self.tags])
        step[~allowed] = -30
        begin = np.array([-30.0 if t[0] == "I" else 0.0 for t in self.tags])
        params = [*shapes, *words, step]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        windows = [x[:, 2 + o : 2 + o + longest] for o in self.OFFSETS]
        one_hot = np.eye(n_tags)[y] * on[..., None]
        for it in range(1, steps + 1):
            e = sum(shapes[k][s[c]] + words[k][l[c]] for k, c in enumerate(windows)) * on[..., None]
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0] + begin
            for t in range(1, longest):
                new = _lse(fwd[:, t - 1, :, None] + step[None], 1) + e[:, t]
                fwd[:, t] = np.where(on[:, t, None], new, fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = _lse(step[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(on[:, t + 1, None], new, 0)
            z = _lse(fwd[:, -1], 1)
            marginal = np.exp(fwd + bwd - z[:, None, None]) * on[..., None]
            grad_e = one_hot - marginal
            grad_step = np.zeros_like(step)
            for t in range(1, longest):
                m = on[:, t]
                pair = np.exp(fwd[m, t - 1, :, None] + step[None] + (e[m, t] + bwd[m, t])[:, None, :] - z[m, None, None])
                grad_step += one_hot[m, t - 1].T @ one_hot[m, t] - pair.sum(axis=0)
            grads = []
            flat = grad_e.reshape(-1, n_tags)
            for table, index in ((shapes, s), (words, l)):
                for k, c in enumerate(windows):
                    g = np.zeros_like(table[k])
                    np.add.at(g, index[c].ravel(), flat)
                    grads.append(g)
            grads.append(np.where(allowed, grad_step, 0))
            for p, g, a, b in zip(params, grads, first, second):
                g = g / len(rows) - decay * np.where(p <= -30, 0, p)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p += 0.15 * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-6)
        self.step, self.begin = step, begin
        self.tables = [np.ascontiguousarray((shapes[k][s] + words[k][l]).astype(np.float32)) for k in range(len(self.OFFSETS))]

    def emissions(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each tag at each word; words beyond a text's ends are the edge."""
        out = self.tables[2][codes]
        begins, ends = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        nonempty = first[:-1] < first[1:]
        begins[first[:-1][nonempty]] = True
        ends[first[1:][nonempty] - 1] = True
        for k, o in ((0, -2), (1, -1), (3, 1)):
            shifted = np.full(len(codes), self.edge)
            if o < 0:
                shifted[-o:] = codes[:o]
                shifted[begins] = self.edge
                if o == -2:
                    shifted[np.flatnonzero(begins)[np.flatnonzero(begins) + 1 < len(codes)] + 1] = self.edge
            else:
                shifted[:-o] = codes[o:]
                shifted[ends] = self.edge
            out = out + self.tables[k][shifted]
        return out

    #: Words decided by one decoded window, and words of context on either side of them.
    CORE, CONTEXT = 64, 8

    def spans(self, w: Words) -> list[tuple[int, int, int, int]]:
        """(document, first word, past the last word, kind) of tagged runs.

        Every text is cut into windows of ``CORE`` words with ``CONTEXT`` more on
        either side, all windows of the batch are decoded at once, and a window
        reports the runs that begin in its core.
        """
        if not len(w.hash):
            return []
        codes, self.core_start, self.core_end = self.features(w)
        e = np.concatenate([self.emissions(codes, w.first), np.full((1, len(self.tags)), -1e4, np.float32)])
        e[-1, 0] = 0  # the word beyond a text
        per_text = -(-w.counts() // self.CORE)
        owner = np.repeat(np.arange(len(w)), per_text)
        begin = w.first[owner] + self.CORE * (np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        size, count = self.CORE + 2 * self.CONTEXT, len(owner)
        place = begin[:, None] - self.CONTEXT + np.arange(size)
        inside = (place >= w.first[owner, None]) & (place < w.first[owner + 1, None])
        score = np.ascontiguousarray(e[np.where(inside, place, len(codes))].transpose(1, 0, 2))
        step = self.step.astype(np.float32)
        best = score[0] + self.begin.astype(np.float32)
        back = np.zeros((size, count, len(self.tags)), dtype=np.int8)
        for t in range(1, size):
            top, arg = best[:, :1] + step[0], np.zeros((count, len(self.tags)), dtype=np.int8)
            for a in range(1, len(self.tags)):
                way = best[:, a : a + 1] + step[a]
                better = way > top
                arg[better] = a
                np.maximum(top, way, out=top)
            back[t] = arg
            best = top + score[t]
        path = np.zeros((size, count), dtype=np.int8)
        tag = best.argmax(axis=1)
        rows = np.arange(count)
        for t in range(size - 1, -1, -1):
            path[t] = tag
            tag = back[t, rows, tag]
        out = []
        core = path[self.CONTEXT : self.CONTEXT + self.CORE]
        for t, r in zip(*np.nonzero(core & 1)):  # tags B have odd places
            t += self.CONTEXT
            kind, z = (int(path[t, r]) - 1) // 2, t + 1
            while z < size and path[z, r] == 2 * kind + 2:
                z += 1
            at = int(begin[r]) - self.CONTEXT
            out.append((int(owner[r]), at + int(t), at + int(z), kind))
        return sorted(out)


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    """The field of ``labelled_table()``, trained once in a process."""
    return Field(labelled_table())


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """(doc_id, base array<struct>, added array<struct>) for every row; structs are (kind, start, end) in code points.

    ``labelled`` trains the field; the default is ``labelled_table()``.  Spans of the
    field that touch a base span, or do not look like their kind (``FORMS``) are left out.  Null and empty texts have no
    spans; repeated rows are searched each; no rows give no rows; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Field(labelled) if labelled else default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, 1):
                texts = texts_of(part.column(1))
                base = [base_spans(t) if t else [] for t in texts]
                added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                w = Words(part.column(1))
                found = field.spans(w)
                if found:
                    lead = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
                    begins = np.concatenate([[0], np.cumsum([len(t) if t else 0 for t in texts])])
                    for d, a, z, k in found:
                        start, end = int(lead[field.core_start[a]] - begins[d]), int(lead[field.core_end[z - 1]] - begins[d])
                        if not looks_like(FIELD_KINDS[k], texts[d][start:end]):
                            continue
                        if start < end and not any(s < end and start < e for s, _, e in base[d]):
                            added[d].append((start, k, end))
                make = lambda spans, names: [{"kind": names[k], "start": s, "end": e} for s, k, e in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([make(b, KINDS) for b in base], kind), pa.array([make(sorted(a), FIELD_KINDS) for a in added], kind)],
                    ["doc_id", "base", "added"],
                )

    source = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, base {span}, added {span}")


def span_digests(found: DataFrame, kinds: tuple[str, ...], more: tuple[str, ...]) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text, by start, then kind as listed."""
    from pyspark.sql import functions as F

    order = F.create_map(*[x for i, k in enumerate((*kinds, *more)) for x in (F.lit(k), F.lit(i))])

    def listed(spans):
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return span_digests(find(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS, FIELD_KINDS)


def digest(spans: list[tuple[int, str, int]]) -> str:
    """The digest of (start, kind, end) spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
