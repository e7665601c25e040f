"""Every stage of the pipeline on odd tables: nulls, empty and long texts, repeated rows, no rows, and extra columns with the names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladewright.llm import chat, decontam, minhash, simhash

SF = "/root/testdata/sf0.001"
NAMES = """fp _leaks _leak _leak_ _of _of_ _times times _copy copy _copies copies _drawn_id _drawn_times _drawn_copy least key root node bands band held size sizes taken target source_size grp t n c b x o
    component_id text_id item item_id coverage tiles w d i k at h g id _key _heavy _h _f _at _size score label quality toxic shard slot text_crc32 law row pos _n _central other rank lead line _d _parts _part _r _g""".split()
GOOD = "Some plain words about the river and the town, written down by hand. " * 8
ODD = [
    (1, GOOD, "en", "a", 1), (1, GOOD, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "word " * 30000, "en", "a", 1), (None, "no id here at all", "fr", "b", 1), (None, "no id here at all", "fr", "b", 1),
    (None, None, None, None, None), (5, "   \n\t ", "de", "c", 1), (6, GOOD + "end", "en", "c", 1), (7, "x", None, None, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_clashing_columns(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), SF)
    wide = stage(spark, odd, SF)
    if name != "shard":
        assert wide.columns == odd.columns
    assert sorted(map(tuple, wide.select(plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert stage(spark, odd.limit(0), SF).collect() == []


def test_stages_keep_and_drop_what_they_say(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted(str(r.doc_id) for r in stages["near_dedup"](spark, odd, SF).collect())
    assert kept == ["1", "2", "4", "7", "None"]  # 3, 5 and the null text without an id are like 2; 6 is like 1
    assert stages["decontaminate"](spark, odd, SF).count() == len(ODD)
    assert {r.doc_id for r in stages["mix"](spark, odd, SF).collect()} >= {2, 3, 5}
    assert stages["shard"](spark, odd, SF).count() == len(ODD)


def test_near_dedup_with_clashing_columns_and_no_ids(spark, odd):
    bare = odd.withColumn("doc_id", F.lit(None).cast("long"))
    for keep in (minhash.keep_first, simhash.keep_first):
        assert keep(bare).columns == odd.columns
        assert keep(bare).count() == len({r.text for r in bare.collect()})


def test_items_without_an_id_decontaminate(spark):
    said = "seven small words make one whole benchmark passage here"
    docs = spark.createDataFrame([(1, "before " + said + " after"), (2, "nothing of that kind stands in this document")], "doc_id long, text string")
    items = spark.createDataFrame([(None, said), (3, said), (None, None), (4, "")], "item_id long, text string")
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [2]
    assert sorted((r.doc_id, str(r.item_id)) for r in decontam.contaminated(docs, items).collect()) == [(1, "3"), (1, "None")]
    assert [r.doc_id for r in decontam.clean(docs, items.filter("item_id is null")).collect()] == [2]
    assert decontam.clean(docs, items.limit(0)).count() == 2


def chats(spark):
    rows = [(1, 0, "user", "é <|im_end|>"), (1, 1, "assistant", ""), (1, 2, "assistant", "so <|im_start|>assistant ok"), (2, 0, "assistant", "x"), (None, 0, "user", "y")]
    return chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))


def test_loss_text_is_read_under_the_mask(spark):
    made = chats(spark)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert got[1].loss_chars == len("so <|im_start|>assistant ok") and got[None].loss_chars == 0 and got[1].n_turns == 3
    # the mask decides, not the role: over the user's text it gives that
    user = made.filter("conv_id = 1").withColumn("loss_spans", F.array(F.struct(F.lit(len("<|im_start|>user\n")).alias("start"), F.length(F.col("parsed")[0]["raw"]).alias("length"))))
    assert chat.read_back(user).first().loss_chars == len("é <|im_end|>")
    assert chat.read_back(made.withColumn("loss_spans", F.slice("loss_spans", 1, 1))).filter("conv_id = 1").first().loss_chars == 0


@pytest.mark.parametrize("change", [
    lambda s: F.transform(s, lambda x: F.struct((x["start"] + 1).alias("start"), x["length"].alias("length"))),
    lambda s: F.transform(s, lambda x: F.struct(F.lit(0).alias("start"), x["length"].alias("length"))),
    lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), (x["length"] + 1).alias("length"))),
    lambda s: F.concat(s, s),
])
def test_a_mask_that_is_not_over_texts_stops_the_query(spark, change):
    made = chats(spark)
    with pytest.raises(Exception, match="loss mask"):
        chat.read_back(made.withColumn("loss_spans", change(F.col("loss_spans")))).collect()


def test_pages_hold_the_text_around_the_image(spark):
    import hashlib

    from cladewright.llm import media

    texts = ["one\ntwo  words\n\nthree & <b>more</b>\nfour", "", None, "a single line", "\n\n", "é\t中\nx"] + ["para %d\n" % i * 3 for i in range(5)]
    got = {r.doc_id: r for r in media.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        before, after = lines[:len(lines) // 2], lines[len(lines) // 2:]
        kept = lambda some: [" ".join(x.split()) for x in some if x.split()]
        assert (got[i].pos, got[i].elements) == (len(kept(before)), len(kept(lines)) + 1)
        assert got[i].text_sha256 == hashlib.sha256("\n".join(kept(before) + kept(after)).encode()).hexdigest() and got[i].n_bytes == len((t or "").encode())
