"""Token groups against the two libraries on whole texts and a plain alignment."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from coffer.llm import alignment

SMALL = "/root/testdata/sf0.001"
TRICKY = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "\na", "a\n", "a\tb", "x y", "x　y", "café naïve", "café",
    "ﬁn", "\U0001f600 ok", "<|endoftext|> in a text", "<s> </s> <unk> <0x41>", "a▁b", "▁", "\x00a", "x​z", "don't we'll I'm it's O'Neil's", "1234 5 67,89", "!!! ... ???",
    "漢字 かな", "word\u0085word", "a\x1cb", "ab\rcd", "z" * 3000, "a b", "tab\t\ttab", "end.\nNext 'll",
]


def _byte_level():
    """Characters of byte-level entries to bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain(texts):
    """Per text (n_a, n_b, groups, links) by whole texts and sets of end offsets."""
    tok, sp = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tok.encode_special_tokens = True
    chars, out = _byte_level(), []
    for t in texts:
        if not t:
            out.append(None)
            continue
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        a_bytes = [bytes(chars[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        raw = (" " + t).encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            out.append(None)
            continue
        a_ends, b_ends = ([sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 5000 else None for x in (a_bytes, b_bytes))
        if a_ends is None or b_ends is None:
            a_ends, b_ends = ([*__import__("itertools").accumulate(map(len, x))] for x in (a_bytes, b_bytes))
        both, found, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
        for end in both:
            x, y = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            found.append((end, a[i:x], b[j:y]))
            i, j = x, y
        out.append(found)
    return out


def _summary(ids, found):
    links = Counter((a[-1], b[-1]) for f in found if f for _, a, b in f)
    best = Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    rows = []
    for d, f in zip(ids, found):
        if f is None:
            rows.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(a[-1], b[-1]) for _, a, b in f]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, a, b in f)
        rows.append((d, sum(len(a) for _, a, _ in f), sum(len(b) for _, _, b in f), len(f), len(f), sum(links[p] == best[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows, key=repr)


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_documents_by_the_libraries(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert _rows(alignment.op12_token_alignment(spark, SMALL)) == _summary([d.doc_id for d in docs], _plain([d.text for d in docs]))


def test_tricky_texts(spark):
    rng = random.Random(3)
    mixed = [t for t in TRICKY if t and len(t) < 100]
    texts = TRICKY + ["".join(rng.choice(mixed) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["same text"] * 3
    ids = [None if i == 5 else i // 2 for i in range(len(texts))]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in zip(ids, texts)], "doc_id long, text string, pairs string")
    plain = _plain(texts)
    assert sum(f is not None for f in plain) > 100
    assert _rows(alignment.alignment_counts(frame)) == _summary(ids, plain)
    got = sorted(((r.doc_id, [(g.end, g.a, g.b) for g in r.groups]) for r in alignment.align(frame).collect()), key=repr)
    assert got == sorted(((d, f or []) for d, f in zip(ids, plain)), key=repr)
    starts = [[g.start for g in r.groups] == [0, *[g.end for g in r.groups]][: len(r.groups)] for r in alignment.align(frame).collect()]
    assert all(starts)
    assert alignment.alignment_counts(frame.limit(0)).collect() == [] == alignment.align(frame.limit(0)).collect()
