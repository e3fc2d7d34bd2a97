"""Lists, pieces and archives beyond what one filter, one state table or one archive holds."""

import pytest
from pyspark.sql import functions as F

from leafmill.llm import common, components, neardup_vectors, urlfilter


def _judged(url, rules):
    """The longest rule that fits, rule by rule."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    fits = [(len(h) + len(p), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return None, "allow"
    longest = max(fits)
    return longest[1] + longest[2], longest[3]


@pytest.mark.parametrize(("most", "at_once"), [(1 << 26, 1 << 28), (1 << 11, 1 << 28), (1 << 11, 1 << 13)])
def test_lists_of_any_size_are_judged_exactly(most, at_once, spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BITS", most)
    monkeypatch.setattr(urlfilter, "PASS_BITS", at_once)
    rules = [("block" if i % 3 else "allow", f"h{i}.net" if i % 2 else f"h{i}.org", ["/", "/a/", "/a/bc"][i % 3]) for i in range(900)]
    urls = [f"http://{'www.' * (i % 3)}h{i}.{'net' if i % 4 else 'org'}/{['', 'a/', 'a/bcd?x', 'b/'][i % 4]}" for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df, table).collect()}
    assert got == {i: _judged(u, rules) for i, u in enumerate(urls)}
    assert sum(r is not None for r, _ in got.values()) >= 300


def test_a_filter_over_its_bits_is_dealt_over_shards_and_passes(spark, monkeypatch):
    from leafmill.llm.common import materialize

    monkeypatch.setattr(urlfilter, "MAX_BITS", 1 << 12)
    monkeypatch.setattr(urlfilter, "PASS_BITS", 1 << 12)
    keys = materialize(spark.range(0, 9000, 9).select(F.concat(F.lit("k"), "id").alias("key")), "keys")
    universe = materialize(spark.range(9000).select(F.concat(F.lit("k"), "id").alias("key")), "universe")
    made = urlfilter.filter_of(keys, universe)
    assert made.shards > 1 and len(made.passes()) > 1 and sorted(k for p in made.passes() for k in p) == list(range(made.shards))
    assert all(c.levels[0][1] <= 1.3 * (1 << 12) for c in made.cascades.values())  # hashed shards of so few keys are uneven
    got = urlfilter.left_of(universe.select(F.array("key").alias("asked"), "key"), made).where("size(asked) > 0")
    assert {r["key"] for r in got.collect()} == {f"k{i}" for i in range(0, 9000, 9)}


def test_states_are_bounded_within_a_piece(monkeypatch):
    import random

    import numpy as np
    import public_tokenizers
    import tiktoken

    from leafmill.llm import bpe, queries

    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(bpe, "MAX_STATES", 500)
    monkeypatch.setattr(bpe, "MATCHES", 50)
    enc = bpe.Encoder(path, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.transducer.ranks, special_tokens={})
    r = random.Random(2)
    word = "".join(r.choices("abcdefgh", k=20_000))
    for text in (word, f"{word} {word}é {'a b ' * 300}", word[:63] + " " + word[:64] + " " + word[:65]):
        ids = enc.encode_bytes(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert len(enc.transducer.states) <= 502
    assert max(map(len, enc.known)) <= bpe.LONGEST


def test_ranked_encoder_only_where_it_is_proved_equal(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from leafmill.llm import packing, queries

    with open(queries.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"] = []
    vocab = {c: i for i, c in enumerate(packing.byte_of_char())}
    start = len(vocab)
    # "abc" is a token that its own bytes never become: "ab" is joined first, and ("ab", "c") is not listed
    spec["model"] |= {"vocab": vocab | {"ab": start, "bc": start + 1, "abc": start + 2}, "merges": [["a", "b"], ["b", "c"], ["a", "bc"]]}
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    made = packing.FileIds(str(path), public_tokenizers.PATTERN)
    assert made.ranked is None
    want = Tokenizer.from_file(str(path)).encode("abc", add_special_tokens=False).ids
    assert made.ids("abc") == b"".join(i.to_bytes(4, "little") for i in want) and len(want) == 2
    spec["model"] |= {"vocab": vocab | {"ab": start, "abc": start + 1}, "merges": [["a", "b"], ["ab", "c"]]}
    path.write_text(json.dumps(spec))
    assert packing.FileIds(str(path), public_tokenizers.PATTERN).ranked is not None


def test_a_star_of_many_links_is_joined_where_it_lies(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(2999, 5000), (9000, 8000)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in [*range(3000), *range(5000, 5201)]}, 8000: 8000, 9000: 8000}


def test_copies_of_one_vector_are_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0 + i], 1) for i in range(900)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {i: (599, 1) if i % 3 else (299, 0) for i in range(900)}
