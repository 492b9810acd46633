"""Secret scan: a character convolutional network in numpy over every candidate and its surrounding context.

Three base patterns find findings that always stay. Further candidates are runs of key-like characters, what base findings leave of
such runs, values of eight characters or more given to a name that speaks of secrets, assignments too short for the base rule,
passwords in addresses and private key blocks. Every candidate and every base finding gets a score from the network, which reads
the characters before, in and after it; longer ones are read through windows that overlap by half, of which the highest counts. Candidates
at or above the threshold are added as kind 'model'. The network is trained here on labelled findings made by a seeded generator; its
scores are calibrated by Platt scaling on findings held out from training, and the threshold is the highest that keeps the wanted
recall on them. That recall holds for the generator's kinds of secrets; it is not a promise for kinds that it does not make.

Texts are scanned whole; null counts as empty and has no findings; repeated rows get equal rows; an empty table gives
no rows; other columns are not read by `scan` and pass unchanged through `redact`, which replaces spans in the text.
Spans count code points, end exclusive; overlapping spans of different kinds are all reported; a score equal to the threshold
counts; of equal spans of one kind there is one.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ["assign", "access", "hex", "model"]
#: Candidates of the network: runs with a letter and a digit, values given to names, passwords in addresses, heads and ends of key blocks.
LEAST_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
NAMED = re.compile(r"""(?:passw(?:or)?d|pwd|passphrase|secret|token|api_?key|access_?key|private_?key|credentials?|auth(?:orization)?)["']?\x20*(?:=>|[:=])\x20*["']?(?:(?:bearer|basic)\x20+)?([^\s"',;]{8,})""", re.ASCII | re.IGNORECASE)
NAME_PARTS = ("passw", "pwd", "passphrase", "secret", "token", "key", "credential", "auth")
ADDRESS = re.compile(r"://[^\s/:@]{1,64}:([^\s/:@]{4,128})@")
BLOCK, BLOCK_END = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
#: Characters that the network reads before, in and after a candidate, and the step of windows over longer ones.
BEFORE, INSIDE, AFTER, STEP = 24, 48, 8, 24
WIDTH = BEFORE + INSIDE + AFTER
WANTED_RECALL, SEED = 0.98, 20240
MASK = "[SECRET]"
#: Windows that are scored at once.
BLOCK_WINDOWS = 4096


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping within a kind."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _left(spans: list[tuple[int, int]], covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the covered stretches leave of the spans (both sorted by start; spans do not overlap)."""
    out, k = [], 0
    for s, e in spans:
        while k < len(covered) and covered[k][1] <= s:
            k += 1
        j = k
        while j < len(covered) and covered[j][0] < e:
            if covered[j][0] > s:
                out.append((s, covered[j][0]))
            s = max(s, covered[j][1])
            j += 1
        if s < e:
            out.append((s, e))
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _mixed(x: str) -> bool:
    """Whether x has a letter and a digit."""
    return any("0" <= c <= "9" for c in x) and any(c.isalpha() for c in x)


def _blocks(text: str) -> list[tuple[int, int]]:
    """Private key blocks, to the end of their END line, or of the BEGIN line where another block begins first or none ends."""
    starts, ends, out, k = [m.span() for m in BLOCK.finditer(text)], [m.end() for m in BLOCK_END.finditer(text)], [], 0
    for i, (s, e) in enumerate(starts):
        while k < len(ends) and ends[k] <= e:
            k += 1
        until = starts[i + 1][0] if i + 1 < len(starts) else len(text)
        out.append((s, ends[k] if k < len(ends) and ends[k] <= until else e))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans for the network beside the base findings: those of them that a base finding covers whole are left out."""
    covered = _union([(a, b) for _, a, b in base])
    spans = [(s, e) for s, e in _left([m.span() for m in RUN.finditer(text)], covered) if e - s >= LEAST_RUN and _mixed(text[s:e])]
    if "PRIVATE KEY" in text:
        spans += _blocks(text)
    low = text.lower()
    if any(n in low for n in NAME_PARTS):
        named = [m.span(1) for m in NAMED.finditer(text)]
        short = [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) < LEAST_VALUE]
        spans += _left(named, covered) + _left(short, covered)
    if "://" in text:
        spans += _left([m.span(1) for m in ADDRESS.finditer(text)], covered)
    return sorted({(s, e) for s, e in spans if e > s})


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The windows over a candidate: itself, or INSIDE characters at each STEP and at its end."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(s, s + INSIDE) for s in range(start, end - INSIDE, STEP)] + [(end - INSIDE, end)]


def window(text: str, start: int, end: int) -> bytes:
    """WIDTH character codes of at most INSIDE characters and those around them: 0 none, 1 not ASCII, else the character with its case."""
    parts = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[start:end].ljust(INSIDE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0")
    return "".join(parts).encode("latin-1", "replace").translate(_CODES)


_CODES = bytes(c if c < 128 and c != 1 else 1 for c in range(256))


class Network:
    """Embedding, one convolution, maximum over the three regions, one dense unit; forward, backward and Adam in numpy."""

    EMBED, FILTERS, SPAN = 10, 24, 5
    REGIONS = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, WIDTH))

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        d = self.EMBED + 1  # and whether the place lies in the candidate
        self.p = {
            "e": r.normal(0, 0.3, (128, self.EMBED)), "k": r.normal(0, (2 / (d * self.SPAN)) ** 0.5, (self.SPAN * d, self.FILTERS)), "c": np.zeros(self.FILTERS),
            "w": r.normal(0, 0.2, 3 * self.FILTERS), "b": np.zeros(1),
        }
        self.a, self.z = 1.0, 0.0  # Platt scaling
        self.threshold = 0.5
        inside = np.zeros(WIDTH)
        inside[self.REGIONS[1][0] : self.REGIONS[1][1]] = 1
        self.inside = inside

    def _forward(self, codes: np.ndarray):
        p, n, half = self.p, len(codes), self.SPAN // 2
        x = np.concatenate([p["e"][codes], np.broadcast_to(self.inside[None, :, None], (n, WIDTH, 1))], 2)
        x = np.pad(x, ((0, 0), (half, half), (0, 0)))
        cols = np.concatenate([x[:, i : i + WIDTH] for i in range(self.SPAN)], 2)
        h = np.maximum(cols @ p["k"] + p["c"], 0)
        tops = [h[:, a:b].argmax(1) + a for a, b in self.REGIONS]
        pooled = np.concatenate([np.take_along_axis(h, t[:, None], 1)[:, 0] for t in tops], 1)
        return cols, tops, pooled, pooled @ p["w"] + p["b"][0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 256])[3] for i in range(0, len(codes), 256)]) if len(codes) else np.zeros(0)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.a * self.logits(codes) + self.z, -60, 60)))

    def train(self, codes: np.ndarray, y: np.ndarray, epochs: int = 7, rate: float = 0.01, batch: int = 64, seed: int = 1) -> None:
        r, p, half = np.random.default_rng(seed), self.p, self.SPAN // 2
        m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                c = codes[at]
                cols, tops, pooled, logit = self._forward(c)
                d = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[at]) / len(at)
                g = {"w": pooled.T @ d, "b": np.array([d.sum()]), "k": np.zeros_like(p["k"]), "c": np.zeros_like(p["c"]), "e": np.zeros_like(p["e"])}
                dp = np.outer(d, p["w"]) * (pooled > 0)
                for j, top in enumerate(tops):
                    dj = dp[:, j * self.FILTERS : (j + 1) * self.FILTERS]
                    picked = np.take_along_axis(cols, top[:, :, None], 1)  # rows of the winners, by filter
                    g["k"] += np.einsum("nfd,nf->df", picked, dj)
                    g["c"] += dj.sum(0)
                    back = dj[:, :, None] * p["k"].T[None]
                    for s in range(self.SPAN):
                        place = top + s - half
                        ok = (place >= 0) & (place < WIDTH)
                        code = np.take_along_axis(c, np.clip(place, 0, WIDTH - 1), 1)
                        np.add.at(g["e"], code[ok], back[:, :, s * (self.EMBED + 1) : s * (self.EMBED + 1) + self.EMBED][ok])
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, codes: np.ndarray, y: np.ndarray, recall: float = WANTED_RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold with the wanted recall."""
        x = self.logits(codes)
        beta, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1)
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(design @ beta, -60, 60)))
            h = (design * (q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
            beta = beta - np.linalg.solve(h, design.T @ (q - y) + 1e-3 * (beta - [1.0, 0.0]))
        self.a, self.z = map(float, beta)
        found = np.sort(self.scores(codes)[y == 1])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5


def findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings: (text, start, end, label), half of them secrets, half look-alikes, from a seeded generator."""
    r = random.Random(seed)
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up, dig, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    mixed, b64 = low + up + dig, low + up + dig + "+/"
    word = lambda: of(low, r.randint(2, 8))
    name = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth", "access_key", "credential", "private_key", "pwd", "AUTH_TOKEN", "DB_PASSWORD", "Authorization: Bearer"])
    plain = lambda: r.choice(["commit", "sha256", "checksum", "etag", "version", "file", "image", "id", "uuid", "url", "host", "model", "see", "isbn", "build", "ref", "from", "digest"])

    def chosen() -> str:
        """A password as people choose them: words and numbers, letters changed for signs."""
        k = r.randrange(4)
        if k == 0:
            return "".join(of(low, r.randint(4, 8)) for _ in range(r.randint(3, 5)))
        if k == 1:
            return of(low, r.randint(3, 6)).capitalize() + of(dig + "!@#$%&*", r.randint(2, 4)) + of(low + dig, r.randint(3, 6))
        if k == 2:
            return of(low, r.randint(2, 4)) + r.choice("@!$#%&") + of(low, r.randint(2, 4)) + of(dig, r.randint(1, 4)) + r.choice(["", "!", "x", "#"])
        return of(low, r.randint(4, 7)) + of(dig, r.randint(2, 5)) + r.choice(["", "!", "_", "#"]) + of(low + up, r.randint(1, 4))

    def secret() -> tuple[str, str]:
        k = r.randrange(13)
        if k == 0:
            return "", r.choice(["ghp_", "gho_", "ghs_"]) + of(mixed, 36)
        if k == 1:
            return "", r.choice(["sk_live_", "rk_live_", "sk-"]) + of(mixed, r.randint(24, 40))
        if k == 2:
            return "", r.choice(["xoxb-", "xoxp-"]) + of(dig, 11) + "-" + of(dig, 11) + "-" + of(mixed, 24)
        if k == 3:
            return "", "AIza" + of(mixed + "_-", 35)
        if k == 4:
            return r.choice(["", "Bearer "]), "eyJ" + of(mixed, 30) + ".eyJ" + of(mixed, 40) + "." + of(mixed + "_-", 43)
        if k == 5:
            return "", r.choice(["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----"])
        if k == 6:
            return r.choice(["postgres", "https", "mysql", "amqp"]) + "://" + word() + ":", r.choice([chosen(), of(mixed, r.randint(8, 20))]) + "@"
        sign = r.choice([" = ", "=", ": ", ' = "', '="', "': '", '": "', " => "])
        if k in (7, 8, 9):
            return name() + sign, chosen()
        return name() + sign, of(r.choice([mixed, b64, hexa, mixed + "_-"]), r.randint(12, 56))

    def look_alike() -> tuple[str, str]:
        k = r.randrange(15)
        sign = r.choice([" ", ": ", "=", " = ", "/"])
        if k == 0:
            return plain() + sign, of(hexa, r.choice([20, 24, 28]))
        if k == 1:
            return plain() + sign, "-".join(of(hexa, i) for i in (8, 4, 4, 4, 12))
        if k == 2:
            return "", "/".join(word() for _ in range(r.randint(2, 9))) + f"/{word()}{of(dig, 2)}.{r.choice(['py', 'html', 'png', 'txt'])}"
        if k == 3:
            return r.choice(["@", "//", "www.", ""]), f"{word()}{of(dig, 1)}.{word()}.{r.choice(['com', 'org', 'net'])}"
        if k == 4:
            return "", "_".join(word() for _ in range(r.randint(2, 9))) + "_" + of(dig, r.randint(1, 3))
        if k == 5:
            return name() + r.choice(["=", ": "]), r.choice(["your_token_here_123", "xxxxxxxxxxxxxxxx1", "changeme-changeme-1", "example_password_1", "00000000000000000a", "insert-key-here-v2", "required", "disabled", "undefined", "(optional)", "<password>", "${PASSWORD}", "os.environ", "getenv(", "********", "self.token", "None)"])
        if k == 6:
            return "base64,", "iVBORw0KGgo" + of(b64, r.randint(10, 37))
        if k == 7:
            return plain() + sign, f"20{of(dig, 2)}-0{of('123456789', 1)}-1{of(dig, 1)}T{of(dig, 2)}.{of(dig, 3)}Z"
        if k == 8:
            return "", f"{word()}-{of(dig, 1)}.{of(dig, 1)}.{of(dig, 2)}-{word()}-{word()}"
        if k == 9:
            return "", word().capitalize() + word().capitalize() + word().capitalize() + of(dig, r.randint(1, 4)) + word()
        if k in (10, 11):  # within a long run of plain data
            chars = r.choice([b64, hexa, low + dig + "/."])
            return of(chars, r.randint(BEFORE, 60)), of(chars, INSIDE)
        if k == 12:  # a name and an ordinary word
            return name() + r.choice([": ", " = "]), of(low, r.randint(8, 13))
        if k == 13:
            return "https://" + word() + ":", of(dig, 4) + "@"
        return name() + r.choice(["=", " = "]), of(low, r.randint(1, 6)) + of(dig, 1)

    out = []
    for i in range(n):
        lead, value = secret() if i % 2 else look_alike()
        if not i % 2 and len(value) < 16 and not lead:
            value += "-" + word() + of(dig, 2) + word()
        left = " ".join(word() for _ in range(r.randint(0, 5)))
        text = left + r.choice([" ", "\n", " | ", "\t"]) + lead
        if i % 16 == 1:  # in a run that goes on
            text += "/".join(word() for _ in range(r.randint(2, 5))) + r.choice(["/", "="])
        at = value.endswith("@")
        value = value.rstrip("@") if at else value
        start, end = len(text), len(text) + min(len(value), INSIDE)
        out.append((text + value + ("@" + word() if at else r.choice(['"', "'", " ", "\n", ",", ";", "!!", "***", ""])) + " " + " ".join(word() for _ in range(3)), start, end, i % 2))
    return out


@cache
def trained(seed: int = SEED, n: int = 7200, recall: float = WANTED_RECALL) -> Network:
    """The network, trained on two thirds of n findings and calibrated on the rest; a few seconds, once a driver process."""
    rows = findings(n, seed)
    codes = np.array([np.frombuffer(window(t, a, b), np.uint8) for t, a, b, _ in rows]).astype(np.int64)
    y = np.array([x[3] for x in rows], float)
    cut = n * 2 // 3
    net = Network(seed)
    net.train(codes[:cut], y[:cut])
    net.calibrate(codes[cut:], y[cut:], recall)
    return net


def scored(texts: list[str], net: Network) -> list[list[tuple[tuple[str, int, int], float]]]:
    """All findings of each text with their scores, in order of start, then kind as listed. Windows are scored in blocks of bounded size."""
    out: list[list] = [[] for _ in texts]
    held: list[tuple[int, str, int, int, int]] = []
    codes: list[bytes] = []

    def flush() -> None:
        if held:
            s = net.scores(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WIDTH).astype(np.int64))
            best = np.maximum.reduceat(s, np.cumsum([0, *(h[4] for h in held[:-1])]))
            for (i, kind, a, b, _), x in zip(held, best.tolist(), strict=True):
                if kind != "model" or x >= net.threshold:
                    out[i].append(((kind, a, b), x))
        held.clear()
        codes.clear()

    for i, text in enumerate(texts):
        base = base_findings(text)
        for kind, a, b in [*base, *(("model", a, b) for a, b in candidates(text, base))]:
            spans = windows(a, b)
            held.append((i, kind, a, b, len(spans)))
            codes += [window(text, s, e) for s, e in spans]
            if len(codes) >= BLOCK_WINDOWS:
                flush()
    flush()
    return [sorted(f, key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2])) for f in out]


def find(texts: list[str], net: Network) -> list[list[tuple[str, int, int]]]:
    """All findings of each text, in order of start, then kind as listed."""
    return [[x for x, _ in f] for f in scored(texts, net)]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, scores (of the spans, in thousandths) of every document."""
    net = net or trained()

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rated = scored([t or "" for t in batch.column(1).to_pylist()], net)
            found = [[x for x, _ in f] for f in rated]
            base = [[x for x in f if x[0] != "model"] for f in found]
            counts = [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in KINDS[:3]]
            hashes = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, pa.array(map(joined, found), pa.string()), pa.array([",".join(str(round(1000 * p)) for _, p in f) for f in rated], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

        return f

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, scores string")


def masked(text: str, found: list[tuple[str, int, int]], mask: str = MASK) -> str:
    """text with each maximal run of overlapping spans replaced by mask."""
    out, at, k = [], 0, 0
    while k < len(found):
        _, start, end = found[k]
        k += 1
        while k < len(found) and found[k][1] < end:
            end = max(end, found[k][2])
            k += 1
        out += [text[at:start], mask]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs with every finding masked in text, all rows and columns as they were (n_chars, if there, follows the text)."""
    net = net or trained()
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            new = [t if not s else masked(t, s) for t, s in zip(texts, find([t or "" for t in texts], net), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([n if a is b else len(b) for a, b, n in zip(texts, new, columns[size].to_pylist(), strict=True)], batch.schema.field(size).type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return f

    return map_batches(docs, make, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
