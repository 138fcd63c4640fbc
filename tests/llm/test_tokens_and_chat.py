import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushmap.llm import chat_template as chat
from hushmap.llm import packed_ids, token_files
from hushmap.llm.shared import BLANK, Tokenized, text_chunks
from tests.llm.helpers import ODD, clashing, documents, words

texts = st.text(alphabet="ab é\n\t\x0b\xa0日", max_size=30)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), texts), max_size=8), st.integers(1, 40))
def test_words_are_found_and_hashed_by_value(rows, limit):
    seen = {}
    for at, to, data, offsets in text_chunks(pa.array(rows, pa.string()), limit):
        found = Tokenized(data, offsets, BLANK)
        hashes = found.hashes()
        for i in range(to - at):
            a, b = found.first[i], found.first[i + 1]
            want = words(rows[at + i])
            got = [bytes(data[s:e]).decode() for s, e in zip(found.start[a:b], found.end[a:b])]
            assert got == want
            for w, h in zip(want, hashes[a:b].tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_rows_are_filled_best_fit(lengths):
    rows = packed_ids.best_fit_decreasing(np.array(lengths, np.int64), 20)
    assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
    free: list[int] = []
    for n in sorted(lengths, reverse=True):  # the plain way: the fullest row that has room
        room = [(f, j) for j, f in enumerate(free) if f >= n]
        if room:
            free[min(room)[1]] -= n
        else:
            free.append(20 - n)
    assert sorted(20 - sum(lengths[i] for i in row) for row in rows) == sorted(free)


def test_packed_rows_give_back_all_tokens(spark):
    rows = ODD + [(i, "t%d " % i * (i * 13 % 400), "s") for i in range(50, 150)] + [(50, "more of it", "s")]
    docs = clashing(documents(spark, rows))
    got = packed_ids.pack_ids(docs, size=256, group_tokens=5_000).collect()
    assert len({r.row_id for r in got}) == len(got)
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), packed_ids.WIDTH)
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any() and r.resets == r.cu_seqlens[:-1]
        places = packed_ids.positions(r.cu_seqlens, 256)
        assert all(places[a] == 0 for a in r.resets)
        for doc, offset, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[doc].append((offset, ids[a:b].tolist()))
    want = defaultdict(list)
    for i, t, _ in rows:
        ids = packed_ids.hash_ids(pa.array([t], pa.string()))[0].tolist()
        want[i] += [(o, ids[o : o + 256]) for o in range(0, len(ids), 256)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert packed_ids.pack_ids(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 10, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    files = {
        "a.txt": [5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 13, 0],
        "b.txt": [0, 3],
        "c.txt": [4] * 30,
        "d.txt": [],
    }
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, token_files.WIDTH).tobytes())
    got = token_files.scan_token_files(spark, str(tmp_path), block_bytes=block).collect()
    want = set()
    for name, ids in files.items():
        start = n = 0
        for i, x in enumerate(ids):
            if x == 0:
                want.add((name, n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.add((name, n, start, len(ids) - start, False))
    assert {(r.file.rsplit("/")[-1], r.ordinal, r.start, r.n_tokens, r.ended) for r in got} == want


def test_token_counts_of_odd_documents(spark, tmp_path):
    rows = ODD + [(4, "said twice over", "a"), (None, "no key", "a")]
    path = str(tmp_path / "docs")
    clashing(documents(spark, rows)).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = token_files.token_counts(docs, "file:" + str(tmp_path / "ids"), block_bytes=1 << 12)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == sorted(
        (str(i), len(words(t))) for i, t, _ in rows
    )


def test_token_counts_of_nothing(spark, tmp_path):
    documents(spark, []).limit(0).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert token_files.token_counts(docs, "file:" + str(tmp_path / "ids")).count() == 0


control = st.sampled_from([*chat.CONTROL, "\\", "[", "<", "/", "s>", "a", "\n", "é", "\\["])


@settings(max_examples=200, deadline=None)
@given(st.lists(control, max_size=12).map("".join))
def test_escape_is_reversible_and_hides_controls(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


@settings(max_examples=100, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), st.text(max_size=5)),
            st.lists(control, max_size=6).map("".join),
        ),
        max_size=6,
    )
)
def test_conversations_are_read_back(turns):
    render = chat.compile_template(chat.TEMPLATE)
    text, spans = render(turns=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    said = [chat.unescape(text[a:b]) for a, b in spans]
    assert said == [t for r, t in turns if r == "assistant"]


def test_language():
    def run(source, **arguments):
        return chat.compile_template(source)(**arguments)[0]

    assert run("{% for x in xs %}{% if loop.first %}<{% endif %}{{ x.n + 1 }}{% if loop.last %}>{% else %},{% endif %}{% endfor %}", xs=[{"n": 1}, {"n": 2}]) == "<2,3>"
    assert run("a {%- if true and not false -%} b {%- else %}c{% endif %}") == "ab"
    assert run("{{ ('x' + 'y') | upper }}{{ missing }}{{ a.b.c }}{{ 1 + 2 }}") == "XY3"
    assert run("{% if a == 1 %}one{% elif a == 2 %}two{% else %}more{% endif %}", a=2) == "two"
    folded = chat.fold(chat.parse("{% if 1 == 2 %}{{ x }}{% else %}a{% endif %}{{ 'b' | upper }}c"))
    assert folded == chat.Block((chat.Output(chat.Const("aBc")),))


@pytest.mark.parametrize(
    "source",
    ["{{ x", "{% if a %}", "{% endif %}", "{{ x | eval }}", "{{ x() }}", "{% for x %}{% endfor %}",
     "{{ a b }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}",
     "{{ " + "(" * 99 + "1" + ")" * 99 + " }}"],
)
def test_bad_templates_are_refused(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_nothing_outside_is_reached():
    out, _ = chat.compile_template("{{ x.__class__ }}{{ x.upper }}")(x="text")
    assert out == ""


def test_odd_conversations(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"),
        (2, None, None, "</s>"), (2, 0, "tool\n", "x\\"), (None, 0, "user", "lost key"),
        (3, 0, "assistant", ""), (3, 0, "assistant", ""),
    ]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    want = {
        1: [("user", ""), ("assistant", "a"), ("assistant", "b")],
        2: [("", "</s>"), ("tool\n", "x\\")],
        3: [("assistant", ""), ("assistant", "")],
        None: [("user", "lost key")],
    }
    for key, turns in want.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[key].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[key].loss_chars == len(loss) and got[key].n_turns == len(turns)
        assert got[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
