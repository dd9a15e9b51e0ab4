"""Plain versions of the queries' results, from lists of rows, to hold the operators against."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

BLANK = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_dedup(docs, at_least=10):
    seen = defaultdict(set)
    key = lambda line: lower(line.strip(BLANK))
    for i, text in docs:
        for line in (text or "").split("\n"):
            seen[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < at_least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def bpe(docs):
    tok, out = library(), []
    for i, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return out


def token_rows(docs):
    """doc_id, n_tokens, crc32 of each document; starts follow from any order of ascending ids."""
    tok, out = library(), []
    for i, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    return out


def fingerprint(text):
    words = blank_words(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[j:j + 3]) for j in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    prints = [fingerprint(t) for _, t in docs]
    up = {p: p for p in prints}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in combinations(up, 2):
        if (a ^ b).bit_count() <= 2:
            up[root(a)] = root(b)
    first = {}
    for (i, _), p in zip(docs, prints):
        if i is not None:
            first[root(p)] = min(i, first.get(root(p), i))
    return [(i, f"{p:016x}", first.get(root(p))) for (i, _), p in zip(docs, prints)]


def articles(pages):
    """For pages whose main text is one article of h1 and p elements."""
    out = []
    for i, url, page in pages:
        found = re.search(r"<article>(.*?)</article>", page or "", re.S)
        parts = re.split(r"</?(?:h1|p|br)>", re.sub(r"</?b>", "", found[1])) if found else []
        blocks = [" ".join(html.unescape(x).split()) for x in parts]
        text = " ".join(b for b in blocks if b)
        out.append((i, url, text, len(text)))
    return out


def chats(turns):
    said = "</s>[INST] ok [/INST]"
    rows = defaultdict(list)
    for conv, turn, role, text in [*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        rows[conv].append((turn is not None, turn, role or "", text or ""))
    out = []
    for conv, mine in rows.items():
        mine.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        loss = "".join(t for *_, r, t in mine if r == "assistant")
        out.append((conv, len(mine), sha("".join(f"{r}\n{t}\n" for *_, r, t in mine)), len(loss), sha(loss)))
    return out


def secrets(docs):
    """doc_id, counts of the base kinds, digest of their spans."""
    out = []
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                        r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, text in docs:
        text = text or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        n = Counter(k for _, k, _ in found)
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        out.append((i, n[0], n[1], n[2], sha(told)))
    return out


def contaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j:j + n])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[j:j + n]))) is not None:
                    hit.update(range(j, j + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def quality_base(docs):
    out = []
    for i, text in docs:
        text = text or ""
        w = blank_words(text)
        at = defaultdict(list)
        for j in range(len(w) - 7):
            at[tuple(w[j:j + 8])].append(j)
        repeat = {k for starts in at.values() if len(starts) > 1 for j in starts for k in range(j, j + 8)}
        lines = [x for x in text.split("\n") if blank_words(x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                    len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w)))
    return out
