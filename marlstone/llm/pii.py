"""Personal data: exact rules by kind, and a linear-chain CRF that adds secrets (credential values).

The CRF has three labels: other, name (the words that announce a value) and secret.
Its features are a word's character classes, length, changes of class, first
characters and, if seen in training, the word itself, as well as those of its
neighbours; each neighbour's share is added from a table of its own, so every
distinct word is looked at once. It is fitted in numpy by forward-backward on a
small labelled table made from templates, and decodes whole texts line by line,
many lines a step (Viterbi). It looks for credentials alone, not for names of people or addresses.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

KINDS = ("email", "ip", "card", "phone", "secret")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A match is the run of local characters before an @ and the domain after it; so each @ is looked at once."""
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        found["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


#: Labelled lines are made of these: names of credentials, words that lead to one in prose, starts of well-known token formats, and what is none.
NAMES = ("token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "access_token", "auth_token", "secret_key", "client_secret", "private_key", "api key", "auth token", "access key", "db_password", "aws_secret", "passphrase", "credential")
PROSE = ("my password is", "the password is", "password is", "the password was", "our token is", "the token is", "the api key is", "secret key is", "use the password", "use the token", "log in with password", "new password:", "the passphrase is", "the secret is")
STARTS = ("ghp_", "gho_", "sk-", "pk_live_", "sk_live_", "AKIA", "ASIA", "xoxb-", "xoxp-", "glpat-", "eyJ", "AIza", "npm_")
ORDINARY = ("the", "of", "and", "a", "is", "for,", "was", "with", "it.", "key", "token", "secret", "password", "keys", "passwords", "=", ":", "###", "***", "|", "A1", "x86", "ISBN", "Licensed", "deface", "cafe", "facade.", "decade", "added", "(see", "below)", "No.", "12", "7", "1984", "3.14", "v2.0.1", "2024-01-02", "10:45", "(020)", "+44", "192.0.2.7", "jo.doe@example.org", "https://example.org/a/b?c=1", "src/main.py", "#1f2e3d", "100%", "$5.00")
ABOUT_HASHES = ("commit", "sha256:", "sha1", "md5", "checksum", "revision", "id", "uuid", "ref", "order", "serial", "hash")
HEX, ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_table(n: int = 800, seed: int = 3) -> list[tuple[list[bytes], str]]:
    """Lines with and without a secret, from the templates above: words, and a label for each (o other, n name, s secret)."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chars = lambda alphabet, a, b: "".join(pick(alphabet) for _ in range(int(r.integers(a, b))))
    made_up = lambda a, b: chars("abcdefghijklmnopqrstuvwxyzaeiouéñüß" if r.random() < 0.9 else "abcdefaeio", a, b)

    def plain() -> str:
        if r.random() < 0.4:
            return pick(ORDINARY)
        if r.random() < 0.04:
            return chars("0123456789", 2, 18)
        word = made_up(2, 40 if r.random() < 0.3 else 12)
        return (word.capitalize() if r.random() < 0.3 else word.upper() if r.random() < 0.05 else word) + pick(("", "", "", ".", ",", "***", "$$$", "|", "!!", "%%%"))

    def value() -> str:
        kind = r.random()
        if kind < 0.35:
            return chars(HEX, 16, 65)
        if kind < 0.7:
            return chars(ALNUM + ("-_" if r.random() < 0.3 else "") + ("+/" if r.random() < 0.2 else ""), 16, 48)
        return made_up(4, 9) + chars("0123456789", 1, 5) + (made_up(3, 8) + chars("0123456789", 0, 3) if r.random() < 0.5 else "") + pick(("", "", "!", "#1", "$"))

    def secret() -> tuple[list[str], str]:
        kind, quote, end = r.random(), pick(('"', '"', "'", "", "")), pick(("", "", ".", ",", ";"))
        if kind < 0.5:  # name = value, name: value, "name": "value"
            name, sign = pick(NAMES).split(), pick(("=", ":"))
            name = [w.upper() for w in name] if r.random() < 0.2 else name
            name[-1] = f'"{name[-1]}"' if quote == '"' and r.random() < 0.2 else name[-1]
            name = [*name, sign] if r.random() < 0.5 else [*name[:-1], name[-1] + sign]
            return [*name, quote + value() + quote + end], "n" * len(name) + "s"
        if kind < 0.65:  # name=value
            name = pick(NAMES).replace(" ", "_")
            return [(name.upper() if r.random() < 0.4 else name) + pick("=:") + quote + value() + quote + end], "s"
        if kind < 0.85:
            name = pick(PROSE).split()
            return [*name, quote + value() + quote + end], "n" * len(name) + "s"
        return [quote + pick(STARTS) + chars(ALNUM, 16, 40) + quote + end], "s"

    def harmless() -> list[str]:
        """Much like a secret, but none."""
        kind = r.random()
        if kind < 0.3:
            return [pick(ABOUT_HASHES), chars(HEX, 7, 65)]
        if kind < 0.4:
            return ["-".join(chars(HEX, k, k + 1) for k in (8, 4, 4, 4, 12))]
        if kind < 0.7:
            return [*pick(PROSE).split(), pick(("under", "here", "kept", "not", "in", "safe", "a", "known", "lost", "too"))]
        return [*pick(NAMES).split(), pick(("of", "and", "for", "=", "is", "was"))]

    rows = []
    for i in range(n):
        before, after = ([plain() for _ in range(int(r.integers(0, 7)))] for _ in range(2))
        core, tags = secret() if i % 2 else ((x := harmless()) and (x, "o" * len(x))) if i % 4 else ([], "")
        words, tags = before + core + after, "o" * len(before) + tags + "o" * len(after)
        if words:
            rows.append(([w.encode() for w in words], tags))
    return rows


CLASSES = bytes(ord("h") if chr(b) in "abcdef" else ord("x") if chr(b).islower() and b < 128 else ord("H") if chr(b) in "ABCDEF" else ord("X") if chr(b).isupper() and b < 128 else ord("0") if 48 <= b < 58 else ord("u") if b > 127 else b for b in range(256))
#: Letters, digits and others, to count changes from one to another.
COARSE = bytes(ord("a") if chr(b).isalpha() or b > 127 else ord("0") if 48 <= b < 58 else ord(".") for b in range(256))
LENGTHS = np.searchsorted([2, 3, 4, 8, 16, 32], np.arange(40), side="right").tolist()
#: Features of a word for its own label, for that of the next word, and for that of the word before.
SLOTS = (6, 1, 1)
#: Lines of more words than this are decoded alone.
ALONE = 2000


def changes(word: bytes) -> int:
    """Steps between letters, digits and others among its first 64 bytes, 9 at most."""
    if word.isalpha():
        return 0
    c = word[:64].translate(COARSE)
    return min(9, sum(map(c.count, (b"a0", b"0a", b"a.", b".a", b"0.", b".0"))))


def assigned(word: bytes) -> bool:
    return b"=" in word[1:-1] or b":" in word[1:-1]


def features(word: bytes) -> tuple[tuple[bytes, ...], ...]:
    size = b"%d" % LENGTHS[min(len(word), 39)]
    kinds = bytes(sorted(set(word.translate(CLASSES))))
    known = word.lower() if len(word) <= 14 else kinds + b"/" + size
    flags = b"%d%d%d" % (b"0" in kinds, any(c in b"hxHXu" for c in kinds), assigned(word))
    own = (b"c" + kinds, b"l" + size, b"w" + known, b"t%d/" % changes(word) + size, b"p" + word.lstrip(b"\"'(")[:4], b"n" + flags)
    return own, (b"<" + known,), (b">" + known,)


class Crf:
    """weights: feature -> scores of the labels; step[a, b]: score of label b after a."""

    LABELS = "ons"

    def __init__(self, weights: dict[bytes, np.ndarray], step: np.ndarray):
        self.weights, self.step = weights, step
        self.zero = np.zeros(len(self.LABELS))

    @classmethod
    def fit(cls, rows: list[tuple[list[bytes], str]], rounds: int = 110, rate: float = 0.15, decay: float = 1e-3) -> Crf:
        lines = [cls.line_features(words) for words, _ in rows]
        seen_in = Counter(f for line in lines for found in line for f in found)
        names = sorted(f for f, n in seen_in.items() if n > 1)
        number, k = {f: i for i, f in enumerate(names)}, len(cls.LABELS)
        t = max(len(w) for w, _ in rows)
        feats = np.full((len(rows), t, sum(SLOTS)), len(names))
        gold, mask = np.zeros((len(rows), t), int), np.zeros((len(rows), t), bool)
        for i, (words, tags) in enumerate(rows):
            for j, found in enumerate(lines[i]):
                feats[i, j, : len(found)], gold[i, j], mask[i, j] = [number.get(f, len(names)) for f in found], cls.LABELS.index(tags[j]), True
        weight, step = np.zeros((len(names) + 1, k)), np.zeros((k, k))
        state = [np.zeros_like(x) for x in (weight, weight, step, step)]
        lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
        for n in range(1, rounds + 1):
            e = weight[feats].sum(2)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for j in range(1, t):
                a[:, j] = np.where(mask[:, j, None], lse(a[:, j - 1, :, None] + step, 1) + e[:, j], a[:, j - 1])
            for j in range(t - 2, -1, -1):
                b[:, j] = np.where(mask[:, j + 1, None], lse(step + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), 0)
            z = lse(a[:, -1], 1)
            p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
            gw, gs = decay * weight, decay * step
            wrong = (p - np.eye(k)[gold] * mask[:, :, None]) / len(rows)
            for label in range(k):
                gw[:, label] += np.bincount(feats.ravel(), np.repeat(wrong[:, :, label].ravel(), feats.shape[2]), len(names) + 1)
            pair = np.exp(a[:, :-1, :, None] + step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            seen = np.zeros_like(step)
            np.add.at(seen, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
            gs = gs + (pair.sum((0, 1)) - seen) / len(rows)
            for x, g, m, v in ((weight, gw, state[0], state[1]), (step, gs, state[2], state[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
            weight[-1] = 0
        return cls({f: weight[i] for f, i in number.items()}, step)

    @staticmethod
    def line_features(words: list[bytes]) -> list[list[bytes]]:
        """The features of each word of a line, its neighbours' share included."""
        own, after, before = zip(*map(features, words), strict=True)
        return [[*own[j], *(after[j - 1] if j else ()), *(before[j + 1] if j + 1 < len(words) else ())] for j in range(len(words))]

    def emission(self, word: bytes) -> np.ndarray:
        """What a word adds to the scores of its own labels, of the next word's, and of those of the word before: (3, labels)."""
        return np.array([sum((self.weights.get(f, self.zero) for f in part), self.zero) for part in features(word)])

    @staticmethod
    def scores(ids: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Scores of the labels of all words of sequences laid end to end; table[id] are emissions."""
        out, begins = table[ids, 0], np.zeros(len(ids) + 1, bool)
        begins[np.cumsum(lengths) - lengths] = True
        inner = np.flatnonzero(~begins[1:-1]) if len(ids) > 1 else np.zeros(0, np.int64)  # words with another after them
        out[inner + 1] += table[ids[inner], 1]
        out[inner] += table[ids[inner + 1], 2]
        return out

    def decode(self, ids: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Best labels of all sequences, laid end to end in ids; table[id] are emissions. Sequences are stepped together, longest first; very long ones go alone."""
        out, at_word = np.zeros(len(ids), np.int8), self.scores(ids, lengths, table)
        begins = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(lengths > ALONE).tolist():
            out[begins[i] : begins[i] + lengths[i]] = self.best_path(at_word[begins[i] : begins[i] + lengths[i]])
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] <= ALONE]
        lengths, starts = lengths[order], begins[order]
        live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")  # longer than t
        if not len(live):
            return out
        score, back = at_word[starts[: live[0]]], []
        final = score.copy()
        for t in range(1, len(live)):
            n = live[t]
            ways = score[:n, :, None] + self.step
            best = ways.argmax(1).astype(np.int8)
            score = ways.max(1) + at_word[starts[:n] + t]
            final[:n] = score
            back.append(best)
        label = final.argmax(1).astype(np.int8)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            out[starts[:n] + t] = label[:n]
            if t:
                label[:n] = back[t - 1][np.arange(n), label[:n]]
        return out

    def best_path(self, at_word: np.ndarray) -> list[int]:
        """Viterbi of one sequence, in plain numbers."""
        step, labels = self.step.T.tolist(), range(len(self.LABELS))
        score, back = at_word[0].tolist(), []
        for here in at_word[1:].tolist():
            ways = [[score[a] + step[b][a] for a in labels] for b in labels]
            tops = [max(w) for w in ways]
            back.append([w.index(top) for w, top in zip(ways, tops, strict=True)])
            score = [top + x for top, x in zip(tops, here, strict=True)]
        path = [score.index(max(score))]
        for best in reversed(back):
            path.append(best[path[-1]])
        return path[::-1]


class Words(dict):
    """Word -> row of the table of emissions; words that the CRF can't tell apart share one."""

    def __init__(self, crf: Crf, limit: int = 400_000):
        super().__init__()
        self.crf, self.limit, self.rows, self.known = crf, limit, [], {}
        self.trained = {f[1:] for f in crf.weights if f[:1] in b"w<>"}
        self.starts = {f[1:] for f in crf.weights if f[:1] == b"p"}

    def __missing__(self, word: bytes) -> int:
        low, start = word.lower() if len(word) <= 14 else b"", word.lstrip(b"\"'(")[:4]
        key = (
            frozenset(word.translate(CLASSES)), LENGTHS[min(len(word), 39)], changes(word), len(word) > 14,
            low if low in self.trained else b"", start if start in self.starts else b"", assigned(word),
        )
        if (row := self.known.get(key)) is None:
            row = self.known[key] = len(self.rows)
            self.rows.append(self.crf.emission(word))
        if len(self) < self.limit and len(word) <= 64:
            self[word] = row
        return row


WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
EDGES = b"\"'.,;:()[]{}<>|*#%&$!"
#: name=value in one word: what follows the sign is the value.
ASSIGNED = re.compile(rb"[A-Za-z_\"'-]+[=:][\"']?(?=[^/=:])")


def code_points(text: bytes) -> np.ndarray | None:
    """Code points before each byte, or None if every byte is one."""
    if text.isascii():
        return None
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(first)))


def secrets(texts: list[bytes], crf: Crf, words: Words) -> list[list[tuple[int, int]]]:
    """Code point spans that the CRF marks, for each text, without quotes and punctuation around; linear in the text."""
    if len(words.known) > words.limit:
        words.clear(), words.rows.clear(), words.known.clear()
    raw = [text.split(b"\n") for text in texts]
    split = [[line.split() for line in lines] for lines in raw]
    lines = [(i, j) for i, t in enumerate(split) for j, w in enumerate(t) if w]
    lengths = np.array([len(split[i][j]) for i, j in lines], np.int64)
    ids = np.array([words[w] for i, j in lines for w in split[i][j]], np.int64)
    labels = crf.decode(ids, lengths, np.array(words.rows)) if len(ids) else np.zeros(0, np.int8)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    ends, at_text = np.cumsum(lengths), -1
    for n in np.unique(np.searchsorted(ends, np.flatnonzero(labels == 2), side="right")).tolist():
        i, j = lines[n]
        if i != at_text:
            at_text, points = i, code_points(texts[i])
            begins = np.cumsum([0] + [len(x) + 1 for x in raw[i]])
        for m, label in zip(WORD.finditer(raw[i][j]), labels[ends[n] - lengths[n] : ends[n]].tolist(), strict=True):
            core = m[0].strip(EDGES) if label == 2 else b""
            if core:
                start = int(begins[j]) + m.start() + m[0].index(core)
                named = ASSIGNED.match(core)
                start, end = start + (named.end() if named else 0), start + len(core)
                out[i].append((start, end) if points is None else (int(points[start]), int(points[end])))
    return out


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"


def find_personal_data(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """SCHEMA for every row: spans of all kinds as kind:start:end in code points, base_sha256 of those by rule alone, n_spans of them all.

    A secret that overlaps a span by rule is left out. Null text counts as empty and
    has no spans. Null doc_ids and repeated rows give a result each; other columns
    are ignored. An empty table gives none.
    """
    crf = crf or Crf.fit(labelled_table())
    shared = docs.sparkSession.sparkContext.broadcast((crf.weights, crf.step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*shared.value)
        words = Words(crf)
        for b in sliced(batches, 1024):
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for text, extra in zip(texts, secrets([t.encode() for t in texts], crf, words), strict=True):
                found = base_spans(text)
                say = lambda: ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in found[k])  # noqa: B023, E731
                base, ruled = say(), [x for k in KINDS for x in found[k]]
                found["secret"] = [(s, e) for s, e in extra if not any(s < y and x < e for x, y in ruled)]
                n = [len(found[k]) for k in KINDS]
                rows.append((*n[:4], hashlib.sha256(base.encode()).hexdigest(), say(), n[4], sum(n)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if k in (4, 5) else pa.int64()) for k, c in enumerate(columns))], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
