import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from tidemill.llm import chat, common, media, warc


@pytest.fixture
def pages(spark):
    common.workers_import_this(spark)
    big = "é\r\n\r\nWARC/1.1\r\n" * 9000
    own = [(1, "u\r\nX: y", None, "q"), (2, None, "short", "q"), (3, "u", "short", None), (None, "u", "n" * 2000, ""), (None, "u", "n" * 2000, ""), (9, "b", big, "r"), (10, "b", big, "r"), (11, "b", "m" * 999, ""), (12, "b", "m" * 999, "")]
    own += [(1000 + i, "u", "c" * 1000, "") for i in range(40)] + [(5, "u", "d" * 1000, "")] * 2
    return spark.createDataFrame(own, "page_id long, url string, html string, payload string")


def test_archives_round_trip(pages):
    index = warc.archive_pages(pages, chunk_bytes=1000)
    chunks = warc.read_archives(index, chunk_bytes=700, span_bytes=5000)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    ids = defaultdict(list)
    for p, h in rows:
        ids[h].append(p)
    want = Counter()
    for p, h in rows:
        first = max((x for x in ids[h] if x is not None), default=None)
        again = len(h) >= 1000 and first is not None and p != first
        want[p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(map(tuple, warc.page_digests(chunks).collect())) == want
    whole = defaultdict(bytes)
    for r in sorted(chunks.filter("page_id in (9, 10, 11)").collect(), key=lambda r: r.chunk):
        whole[r.page_id] += r.data
        assert r.sha1_so_far == hashlib.sha1(whole[r.page_id]).hexdigest() and r.bytes_so_far == len(whole[r.page_id]) and len(r.data) <= 700
    assert whole[10] == dict(rows)[10] and whole[9] == b"" and whole[11] == b"m" * 999
    assert warc.read_archives(warc.archive_pages(pages.limit(0))).count() == 0


def test_damaged_chunks_are_found(spark, pages):
    chunks = warc.chunk_table(warc.records(pages), 1000).withColumn("payload_digest", common_digest())
    with pytest.raises(Exception, match="do not have its digest"):
        warc.write_archives(chunks, common.new_path(spark, "bad"))


def common_digest():
    from pyspark.sql import functions as F

    return F.sha1(F.lit("other"))


CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("budget", [60, 300, 1024])
def test_chat_round_trip(spark, budget):
    told = "</s>[INST] ok [/INST]"
    own = [(-1, 0, "user", told), (-1, 1, "assistant", told), (None, None, None, None), (None, 3, "assistant", "a")]
    own += [(-2, 0, "system", "be <|im_end|>\n<|im_start|>user\nkind \\ \\\\"), (-2, 1, "us\ner\\n", "<<SYS>> <s> </s> \\<s>"), (-3, 0, "assistant", ""), (-3, 0, "assistant", "")]
    own += [(-4, i, "system" if i == 0 else ["user", "assistant"][i % 2], "wörd [INST] " * (i % 30)) for i in range(600)]
    own += [(-5, -5, "user", "q"), (-5, 300, "assistant", "x y " * 900), (-5, 300, "assistant", "x y " * 900), (-6, 0, "system", "only"), (-7, 2, "system", "not first"), (-7, 1, "user", "u")]
    df = spark.createDataFrame(own, CHAT)
    windows = chat.format_windows(df, budget=budget, history_turns=2, history_tokens=budget // 8)
    want = defaultdict(list)
    for c, t, r, x in own:
        want[c].append((-(1 << 62) if t is None else t, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = chat.conversation_digests(windows).collect()
    assert len(rows) == len(want)
    for r in rows:
        turns = sorted(want[r.conv_id])
        learned = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)), len(learned), sha(learned))
    for w in windows.filter("conv_id = -4").collect():
        assert w.formatted.startswith("<|im_start|>system") and (w.tokens <= budget or w.formatted.count("<|im_start|>") - w.n_repeated == 1)
        assert w.formatted.count("<|im_start|>") == w.formatted.count("<|im_end|>")
        assert w.n_repeated <= 3
    assert chat.conversation_digests(chat.format_windows(df.limit(0))).count() == 0


def history(windows, conv):
    return [(w.span, w.n_repeated, w.formatted) for w in windows.filter(f"conv_id = {conv}").orderBy("span").collect()]


def test_windows_do_not_depend_on_how_rows_are_dealt(spark):
    own = [(1, k * 1000, "system" if k == 0 else ["user", "assistant"][k % 2], f"turn {k} " + "word " * (k * 7 % 40)) for k in range(700)]
    own += [(2, None, "user", f"t{k:04d} " + "x " * (k % 9)) for k in range(700)]
    df = spark.createDataFrame(own, CHAT)
    few = chat.format_windows(df.repartition(1), budget=200, history_turns=3, history_tokens=60)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = chat.format_windows(df.repartition(9), budget=200, history_turns=3, history_tokens=60)
        assert common.materialize(many, "many").filter("conv_id = 1").count() > 20
        got = [history(many, c) for c in (1, 2)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [history(few, c) for c in (1, 2)]
    turns = sorted(own[:700], key=lambda r: r[1])
    tokens = [len(x[3].split()) + sum(c.isdigit() for w in x[3].split() for c in w) - sum(w.isdigit() for w in x[3].split()) + 4 for x in turns]
    spans = [w[0] for w in got[0]]
    for span, repeated, formatted in got[0][1:]:  # the longest run of turns before the first that fits, and the system turn
        fits, at = 0, span - 2
        while fits < 3 and at - fits >= 1 and sum(tokens[at - fits : at + 1]) <= min(60, 200 - tokens[0] - tokens[span - 1]):
            fits += 1
        assert repeated == 1 + fits and formatted.startswith("<|im_start|>system\nturn 0 ") and len(spans) == len(set(spans))


def test_chat_runs_no_python(spark):
    plan = chat.conversation_digests(chat.format_windows(spark.createDataFrame([], CHAT)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_feature(p):
    """The feature as plain loops."""
    n, mean = len(p), sum(p) / len(p)
    numbers = [mean, (sum((x - mean) ** 2 for x in p) / n) ** 0.5, sum(abs(a - b) for a, b in zip(p, p[1:])) / (n - 1), *[sum(x >> 5 == k for x in p) / n for k in range(8)]]
    rows = [[sum(p[r * 64 + c * 8 : r * 64 + c * 8 + 8]) / 8 for c in range(8)] for r in range(n // 64)]
    bands, k = min(8, len(rows)), 0
    sizes = [len(rows) // bands + (i < len(rows) % bands) for i in range(bands)]
    small = []
    for size in sizes:
        small += [sum(rows[k + i][c] for i in range(size)) / size for c in range(8)]
        k += size
    middle = sum(small) / len(small)
    bits = "".join("1" if v > middle else "0" for v in small).ljust(64, "0")
    return ";".join(f"{v:.6f}" for v in numbers) + f";{int(bits, 2):016x}"


def test_media_columns(spark):
    common.workers_import_this(spark)
    own = [(None, None), (1, ""), (1, "x" * 64), (2, "<p>&amp;<img src='x'>\n</figure>"), (3, "é" * 70), (4, "é" * 70), (5, "\x00\r\n"), (6, "one\n\ntwo\nthree & <![foo bar]>\n" * 30), (7, "long line\n" * 20_000)]
    got = media.media_columns(spark.createDataFrame([(*r, "f") for r in own], "doc_id long, text string, feature string")).collect()
    want = Counter()
    for d, t in own:
        b = (t or "").encode()
        p = b + bytes((-len(b)) % 64 or (0 if b else 64))
        lines = (t or "").split("\n")
        behind = sum(bool(x.strip()) for x in lines[: (len(lines) + 1) // 2])
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), plain_feature(p) if len(p) < 9000 else None, 1 + sum(bool(x.strip()) for x in lines), behind] += 1
    assert Counter((*tuple(r)[:5], r.feature if r.payload_bytes < 9000 else None, r.n_items, r.position) for r in got) == want
    same = [tuple(r)[1:] for r in got if r.doc_id in (3, 4)]
    assert same[0] == same[1]
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_markup_loses_no_text(spark):
    import random

    assert [i["text"] for i in media.parse_sequence("<p>a</p><![foo bar]>x")] == ["a", "x"]
    figure = media.parse_sequence("<figure><figcaption>before</figcaption><img src=u alt=z></figure>")
    assert [(i["kind"], i["src"], i["caption"]) for i in figure] == [("media", "u", "before")]
    assert [(i["kind"], i["src"]) for i in media.parse_sequence("<video><source src=v.mp4></video><audio src=a.ogg>")] == [("media", "v.mp4"), ("media", "a.ogg")]
    rnd = random.Random(1)
    parts = ["<", "!", "[", "]", ">", "p", "<img src=x>", "<figure>", "</", "-", "--", "doctype", "CDATA", " ", "a", "&", "&#1", "<figcaption>", "\n", "?", "<script>", "'", '"', "\x00"]
    for _ in range(3000):
        items = media.parse_sequence("".join(rnd.choices(parts, k=rnd.randint(1, 25))))
        assert [i["position"] for i in items] == list(range(len(items)))


def test_png_round_trip_and_damage():
    payload = bytes(range(256)) * 3
    stored = media.to_png(payload)
    assert media.from_png(stored) == payload and media.feature_of(payload) == media.feature_of(media.from_png(stored))
    with pytest.raises(ValueError):
        media.from_png(stored[:60] + b"\x00" + stored[61:])


def test_sequences_keep_positions_and_captions(spark):
    common.workers_import_this(spark)
    source = "<h1>T</h1><p>a &amp; b<figure><img src='sha256:ab' alt='z'><figcaption>cap</figcaption></figure>tail<script>var x='<p>'</script><img src=http://x><p>end"
    items = media.parse_sequence(source)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "T", None, None), (1, "text", "a & b", None, None), (2, "media", None, "ab", "cap"), (3, "text", "tail", None, None), (4, "media", None, None, None), (5, "text", "end", None, None)]
    assert [i["src"] for i in items if i["kind"] == "media"] == ["sha256:ab", "http://x"]
    seq = media.interleaved(spark.createDataFrame([(1, source), (2, None)], "doc_id long, html string"))
    known = spark.createDataFrame([("ab", 5)], "digest string, n long")
    rows = sorted(media.resolve(seq, known).collect(), key=lambda r: r.position)
    assert [(r.doc_id, r.n_items, r.position, r.text, r.caption, r.n) for r in rows] == [(1, 6, 0, "T", None, None), (1, 6, 1, "a & b", None, None), (1, 6, 2, None, "cap", 5), (1, 6, 3, "tail", None, None), (1, 6, 4, None, None, None), (1, 6, 5, "end", None, None)]
