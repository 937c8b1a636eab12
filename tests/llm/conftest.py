"""Small tables with everything odd in them, and tables without rows."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("k", pa.string()), ("score", pa.float64()), ("grp", pa.int64())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("x", pa.float64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("h", pa.string())]),
}
#: Columns that operators use inside, in tables that they read.
CLASHING = [("k", pa.string()), ("score", pa.float64()), ("n", pa.int64()), ("label", pa.int32()), ("host", pa.string()), ("t", pa.string()), ("c", pa.int64()), ("good", pa.bool_())]
for _name in ("labels", "pages", "benchmark"):
    for _field in CLASHING:
        SCHEMAS[_name] = SCHEMAS[_name].append(pa.field(*_field))


def prose(r, n):
    words = [r.choice(["the", "of", "and", "to", "in"]) if r.random() < 0.4 else "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n)]
    return " ".join(w + ("." if k % 12 == 11 else "") for k, w in enumerate(words)).replace(". ", ".\n")


def odd_tables():
    r = random.Random(8)
    texts = [prose(r, r.randint(5, 200)) for _ in range(40)]
    passage = prose(r, 40)
    base = prose(r, 120).split()
    near = base.copy()
    near[60] = "changed"
    texts += [
        None, "", "   \n\t ", "one", "one two three", texts[0], texts[0], texts[1] + "\n" + texts[1], " ".join(base), " ".join(near), prose(r, 60) + " " + passage + " " + prose(r, 80),
        "mail a.b@c.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111 at 10.0.0.255 and 9000426309966109.", "x" * 200_000, prose(r, 30_000), "日本語 текст émoji 🙂 İ <|endoftext|>",
        "ABC!! DEF!! GHI!! " * 30, "a*** b$$$ c&&& d%%% e### " * 20, "   \x1c \x85",
    ]
    docs = [dict(doc_id=i, text=t, lang=r.choice(["en", "fr", None]), source="s", n_chars=None if t is None else len(t), k="x", score=0.5, grp=1) for i, t in enumerate(texts)]
    docs += [dict(docs[3]), dict(docs[2], doc_id=None), dict(docs[5], lang=None, source=None, n_chars=None)]
    labels = [dict(doc_id=i, quality=int(i % 5 != 0), toxic=0) for i in range(40)] + [dict(doc_id=3, quality=None, toxic=None), dict(doc_id=None, quality=1, toxic=0), dict(doc_id=4, quality=0, toxic=0), dict(doc_id=4, quality=1, toxic=0)]
    urls = [None, "", "no-scheme", "http://", "http://EXAMPLE.net/en/1?x#y", "https://a.example.com/de/9", "http://x.org/fr/3", "http://net", "http://net/", "http://b.net?q=/en/", "ftp://ex.com:80/a#b", "http://ünï.example.org/é"]
    urls += [f"http://h{i % 7}.example.{('net', 'com', 'org')[i % 3]}/{('en', 'de', 'fr')[i % 4 % 3]}/{i}" for i in range(80)]
    pages = [dict(page_id=i, url=u, html="<p>") for i, u in enumerate(urls)] + [dict(page_id=None, url=urls[4], html=None)]
    items = [dict(item_id=0, text=passage), dict(item_id=1, text=None), dict(item_id=2, text=""), dict(item_id=3, text="one two three"), dict(item_id=0, text=passage), dict(item_id=5, text=prose(r, 30))]
    point = lambda scale: [r.gauss(0, scale) for _ in range(64)]
    middles = [point(1) for _ in range(6)]
    vectors = [dict(vec_id=i, embedding=[m + r.gauss(0, 0.2) for m in middles[i % 6]]) for i in range(150)]
    vectors += [dict(vec_id=200 + i, embedding=middles[0]) for i in range(20)] + [dict(vec_id=7, embedding=middles[1]), dict(vectors[9]), dict(vec_id=None, embedding=point(1)), dict(vec_id=-5, embedding=[0.0] * 64)]
    vectors += [dict(vec_id=300, embedding=None), dict(vec_id=301, embedding=[]), dict(vec_id=302, embedding=[0.5] * 63), dict(vec_id=303, embedding=[*[0.5] * 63, None]), dict(vec_id=304, embedding=[*[0.5] * 63, float("nan")]), dict(vec_id=305, embedding=[*[0.5] * 63, float("inf")])]
    vectors += [dict(vec_id=306, embedding=[1.0] * 65), dict(vec_id=307, embedding=[5e6 * v for v in point(1)])]
    return {"documents": docs, "labels": labels, "pages": pages, "benchmark": items, "embeddings": vectors}


def save(folder, tables):
    for name, schema in SCHEMAS.items():
        pq.write_table(pa.Table.from_pylist(tables.get(name, []), schema), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    return save(tmp_path_factory.mktemp("odd"), odd_tables())


@pytest.fixture(scope="session")
def odd_docs():
    return odd_tables()["documents"]


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return save(tmp_path_factory.mktemp("empty"), {})
