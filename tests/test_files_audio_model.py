"""File source (S12-S14, X9, N1), audio (S15, F17, P5), model calls (model_map, G*)."""
import io
import os
import zipfile

from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog.functions import text as T
from learnlog.operators import history as H
from learnlog.operators import model as M
from learnlog.sources import files as FS

DOCX_XML = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>Pierwszy </w:t></w:r><w:r><w:t>akapit</w:t></w:r></w:p>
<w:p><w:r><w:t>   </w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>tabela</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>Drugi</w:t><w:tab/><w:t>x</w:t></w:r></w:p>
</w:body></w:document>"""


def _docx_bytes():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", DOCX_XML)
    return b.getvalue()


def _write(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_file_gate_and_extraction(spark, scratch):
    _write(scratch, "utf.txt", "zażółć gęślą".encode("utf-8"))
    _write(scratch, "win.TXT", "zażółć".encode("cp1250"))
    _write(scratch, "bad81.txt", b"abc\x81def")
    _write(scratch, "empty.txt", b"")
    _write(scratch, "doc.docx", _docx_bytes())
    _write(scratch, "notzip.docx", b"hello")
    _write(scratch, "noext", b"x")
    _write(scratch, "big.txt", b"a" * (K.MAX_FILE_SIZE_BYTES + 1))
    _write(scratch, "edge.txt", b"a" * K.MAX_FILE_SIZE_BYTES)
    files = FS.list_files(spark, scratch)
    g = {r.name: (r.ok, r.reason) for r in FS.gate(files).collect()}
    assert g["big.txt"] == (False, K.MSG_FILE_TOO_LARGE)
    assert g["edge.txt"][0] is True                       # exactly 10 MB passes
    assert g["noext"] == (False, K.MSG_UNSUPPORTED_FORMAT + ": noext")
    assert g["win.TXT"][0] is True                        # extension is lower-cased
    # the size filter reaches the file source
    plan = FS.list_files(spark, scratch, max_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan and "LessThanOrEqual" in plan or "<=" in plan
    out = {r.name: r for r in FS.read_texts(spark, scratch).collect()}
    # a file that the gate turns away keeps a row, with the reason
    assert (out["big.txt"].text, out["big.txt"].error) == (None, K.MSG_FILE_TOO_LARGE)
    assert out["big.txt"].length == K.MAX_FILE_SIZE_BYTES + 1
    assert (out["noext"].text, out["noext"].error) == (None, K.MSG_UNSUPPORTED_FORMAT + ": noext")
    assert len(out["edge.txt"].text) == K.MAX_FILE_SIZE_BYTES and out["edge.txt"].error is None
    assert (out["utf.txt"].text, out["utf.txt"].encoding) == ("zażółć gęślą", "utf-8")
    assert (out["win.TXT"].text, out["win.TXT"].encoding) == ("zażółć", "cp1250")
    # 0x81 is undefined in cp1250, so the next encoding in the list decodes it
    assert out["bad81.txt"].encoding == "iso-8859-2"
    # zero-length files produce no row in the binaryFile scan (an empty upload has no text)
    assert "empty.txt" not in out
    assert out["doc.docx"].text == "Pierwszy akapit\nDrugi\tx"
    assert out["notzip.docx"].text is None and out["notzip.docx"].error.startswith(FS.READ_ERROR_PREFIX)


def test_audio_base64_and_validity(spark):
    rows = [(0, None), (1, b""), (2, b"x" * 999), (3, b"x" * 1000), (4, bytes(range(256)) * 2)]
    df = spark.createDataFrame(rows, "id int, audio binary")
    rec = H.translation_records(df.select("id", "audio", F.lit("a").alias("input_text"),
                                          F.lit("b").alias("output_text"), F.lit("angielski").alias("language"),
                                          F.lit("alloy").alias("voice")), audio="audio")
    got = rec.select("has_audio", "audio_data").collect()
    assert [r.has_audio for r in got] == [False, False, True, True, True]
    import base64
    assert got[4].audio_data == base64.b64encode(rows[4][1]).decode()   # no line breaks
    ok = {r.id: r.v for r in df.select("id", T.audio_ok("audio").alias("v")).collect()}
    assert ok == {0: False, 1: False, 2: False, 3: True, 4: False}
    back = df.select("id", F.unbase64(T.b64("audio")).alias("a")).collect()
    assert [r.a for r in back][1:] == [bytearray(x[1]) for x in rows[1:]]


def test_model_map_isolates_failures(spark):
    class FlakyClient:
        """Raises on prompts containing 'boom'; fails the first attempt on 'retry'."""
        calls: dict = {}

        def complete(self, system, user, max_tokens, temperature, task=""):
            if "boom" in user:
                raise RuntimeError("rate limit")
            n = FlakyClient.calls.get(user, 0)
            FlakyClient.calls[user] = n + 1
            if "retry" in user and n == 0:
                raise RuntimeError("transient")
            return user.upper()

    df = spark.createDataFrame([(1, "ok text"), (2, "boom"), (3, "retry me"), (4, None)], "k long, t string")
    out = M.model_map(df, ["k"], F.lit("sys"), F.col("t"), "translate", client_factory=FlakyClient,
                      attempts=2, concurrency=2).collect()
    got = {r.k: (r.reply, r.error) for r in out}
    assert got[1] == ("OK TEXT", None)
    assert got[2] == (None, "rate limit")
    assert got[3] == ("RETRY ME", None)
    assert got[4] == (None, None)


def _client():
    """A stand-in for the model: replies by task; a user prompt with "boom" fails. (A class made
    here is sent to the workers by value.)"""
    class Client:
        def complete(self, system, user, max_tokens, temperature, task=""):
            if "boom" in user:
                raise RuntimeError("rate limit")
            if task == "analyze":
                return '{"vocabulary_items": [{"word": "w1"}, {"word": "w2"}]}' if "json" in user else "no analysis"
            if task == "speech":
                return user.encode("utf-8") * 100
            return f" {user} "
    return Client


def test_translate_pipeline_validates_before_calling(spark):
    df = spark.createDataFrame([(1, "  Ala <ma> kota  ", "angielski"), (2, "ab", "angielski")],
                               "k long, t string, lang string")
    got = {r.k: (r.output, r.error) for r in M.translate(df, "k", "t", "lang", M.calling(_client())).collect()}
    assert got[1] == ("Przetłumacz na angielski: Ala ma kota", None)
    assert got[2] == (None, K.MSG_TEXT_TOO_SHORT)


def test_long_texts_are_sent_whole(spark):
    text = "x" * 50_000
    df = spark.createDataFrame([(1, text, "angielski")], "k long, t string, lang string")
    out = M.correct(df, "k", "t", "lang", M.calling(_client())).first()
    assert out.output.count("x") == 50_000 and out.explanation.count("x") >= 100_000 and out.error is None


def test_analyze_failure_gives_tip(spark):
    df = spark.createDataFrame([(1, "json", "angielski"), (2, "boom", "angielski"), (3, "prose", "angielski")],
                               "k long, t string, lang string")
    got = {r.k: r for r in M.analyze(df, "k", "t", "lang", M.calling(_client())).collect()}
    assert [v.word for v in got[1].analysis.vocabulary_items] == ["w1", "w2"]
    for k, error in ((2, "rate limit"), (3, K.MSG_AI_PARSE_ERROR)):
        assert got[k].analysis.vocabulary_items == [] and got[k].error == error
        assert got[k].analysis.learning_tips[0].endswith(error)


def test_prompts_carry_no_text_columns(spark):
    df = spark.createDataFrame([(1, "abc", "angielski")], "k long, t string, lang string")
    seen = []

    def call(df, keys, system, user, task, binary=False):
        seen.append((task, list(keys)))
        return df.select(*keys, F.lit("reply").alias("reply"), F.lit(None).cast("string").alias("error"))

    M.correct(df, "k", "t", "lang", call).collect()
    assert seen == [("correct", ["k"]), ("explain_correction", ["k"])]


def test_save_pipelines_store_only_what_succeeded(spark, scratch):
    from learnlog.sources.store import HistoryStore
    store = HistoryStore(spark, f"{scratch}/h")
    df = spark.createDataFrame([(1, "some json text", "angielski"), (2, "boom goes this", "angielski"),
                                (3, "x", "niemiecki"), (4, "plain prose", "niemiecki")], "k long, t string, lang string")
    call = M.calling(_client(), store_path=f"{scratch}/replies")
    store.append(M.translation_records(df, "k", "t", "lang", call, speech_call=call))
    store.append(M.correction_records(df, "k", "t", "lang", call))
    store.append(M.analysis_records(df, "k", "t", "lang", call))
    rows = store.read().collect()
    kinds = {m: sorted(r.input_text for r in rows if r.mode == m) for m in {r.mode for r in rows}}
    assert kinds == {"translation": ["plain prose", "some json text"],            # 2 failed, 3 is too short
                     "correction": ["plain prose", "some json text", "x"], "analysis": ["some json text"]}
    t = H.get_translations(store.read()).collect()
    assert all(bytes(r.audio_data) == r.output.encode() * 100 for r in t) and len(t) == 2
    assert [r.n_vocabulary for r in rows if r.mode == "analysis"] == [2]
    assert len({r.id for r in rows}) == len(rows) and all(r.ts for r in rows)


def test_recorded_replies(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "new"), (4, None)], "k long, t string")
    replies = spark.createDataFrame([("abc", "r1"), ("abc", "r2"), ("other", "r3")], "t string, reply string")
    table = replies.select(M.prompt_hash("translate", F.lit("s"), F.col("t")).alias("prompt"), "reply")
    got = M.recorded(table)(df, ["k"], F.lit("s"), F.col("t"), "translate").collect()
    assert {r.k: (r.reply, r.error) for r in got} == {1: ("r2", None), 2: ("r2", None), 3: (None, M.NO_RECORDED_REPLY),
                                                      4: (None, None)}
    other = M.recorded(table)(df, ["k"], F.lit("s"), F.col("t"), "correct").collect()
    assert {r.error for r in other} == {M.NO_RECORDED_REPLY, None}  # another task is another request


def test_filled_in_text_is_not_a_template(spark):
    df = spark.createDataFrame([("see {corrected} and {original}", "FIXED", None)], "o string, c string, n string")
    out = df.select(M.fill("a {original} b {corrected} c {word} {unknown} { x } {none}", original=F.col("o"),
                           corrected=F.col("c"), word=F.lit("w"), none=F.col("n"))).first()[0]
    assert out == "a see {corrected} and {original} b FIXED c w {unknown} { x } "


def test_stored_replies_are_not_requested_twice(spark, scratch):
    log = os.path.join(scratch, "calls.log")

    class CountingClient:
        def complete(self, system, user, max_tokens, temperature, task=""):
            with open(log, "a") as f:
                f.write(user + "\n")
            if "fail" in user:
                raise RuntimeError("boom")
            return user[::-1]

    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "xyz"), (4, "fail"), (5, None)],
                               "k long, t string")
    store = os.path.join(scratch, "replies")

    def run():
        return {r.k: (r.reply, r.error) for r in M.model_map_stored(
            df, ["k"], F.lit("sys"), F.col("t"), "translate", store, client_factory=CountingClient,
            attempts=1).collect()}

    first = run()
    assert first[1] == ("cba", None) and first[2] == ("cba", None) and first[3] == ("zyx", None)
    assert first[4] == (None, "boom") and first[5] == (None, None)
    calls = open(log).read().split()
    assert sorted(calls) == ["abc", "fail", "xyz"]          # identical prompts sent once
    second = run()
    assert second == first
    calls = open(log).read().split()
    assert sorted(calls) == ["abc", "fail", "fail", "xyz"]  # only the failed prompt is retried


def test_supported_formats(spark):
    got = {r.ext: r.description for r in FS.supported_formats(spark).collect()}
    assert set(got) == set(K.SUPPORTED_FILE_TYPES)
