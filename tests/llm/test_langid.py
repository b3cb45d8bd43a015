import zlib

from cases import documents

from graphloom.llm import langid


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = langid.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.96 * len(held)
    sure = [r for r in held if not r.rejected]
    assert sum(r.lang_pred == r.lang for r in sure) >= 0.97 * len(sure) and len(sure) > 0.9 * len(held)
    assert all(0 <= r.score <= 1 and (r.score < 0.5) == r.rejected for r in rows)


def test_cases(spark):
    docs = documents(spark).selectExpr("*", "1 as lang_pred", "2 as fits", "3 as draw")
    rows = {str(r.doc_id): r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [rows[str(i)].lang_pred for i in (0, 1, 2, 13)] == ["und"] * 4
    assert rows["0"].score == 0 and rows["4"].lang_pred in ("en", "fr")
    assert langid.predict(docs.limit(0), langid.learn(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_learning_reads_only_its_part(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "case when pmod(crc32(cast(string(doc_id) as binary)), 4) = 2 then 'xx' else lang end lang")
    assert langid.learn(docs) == langid.learn(other)
    assert "xx" not in langid.learn(other)


def test_long_and_single_language():
    c = langid.Classifier({"en": [b"the cat sat on the mat and the dog"], "de": [b"die katze und der hund sind im haus"]})
    assert c.predict("The cat and the dog sat on the mat " * 20000)[0] == "en"
    assert c.predict("Die Katze und der Hund")[0] == "de"
    assert langid.Classifier({"en": [b"some words here"]}).predict("words") == ("en", 1.0)


def test_copies_and_long_texts_do_not_hide_a_language(spark):
    rows = [(i, "the same old text is here again and again " * 6, "en") for i in range(3000)]
    rows += [(5000 + i, f"another text, number {i}, speaks of the weather and of the sea " * 4, "en") for i in range(40)]
    rows += [(7001 + i, "die Katze und der Hund liegen unter dem alten Baum am Fluss " * 400, "de") for i in range(2)]
    rows += [(8000 + i, f"le chat numero {i} dort sur le tapis", "fr") for i in range(4)]
    dictionaries = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(dictionaries) == ["de", "en", "fr"]
    assert sum(b"weather" in x for x in dictionaries["en"]) == langid.SHARDS
    assert all(len(x) <= langid.DICTIONARY for own in dictionaries.values() for x in own)


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "FULL_LANGUAGES", 4)
    rows = [(100 * k + i, f"word{k} other{k} third{k} text {i}", f"l{k}") for k in range(90) for i in range(8)]
    assert len(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == 90


def test_equal_sizes_go_to_the_first_by_name():
    same = [b"the same dictionary for both"]
    assert langid.Classifier({"b": same, "a": same}).predict("some text") == ("a", 0.0)


def brute(text, dictionaries):
    """Sizes from plain zstandard calls, one dictionary after another."""
    import statistics

    import zstandard

    found = langid.letters(text or "")
    if not found:
        return "und"
    sizes = []
    for lang, shards in dictionaries.items():
        own = []
        for shard in shards:
            how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0)
            d = zstandard.ZstdCompressionDict(shard, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.append(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(found)))
        sizes.append((statistics.median_high(own), lang))
    return min(sizes)[1]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    dictionaries = langid.learn(docs)
    want = sorted((r.doc_id, brute(r.text, dictionaries)) for r in docs.collect())
    assert sorted((r.doc_id, r.lang_pred) for r in langid.query(spark, d).collect()) == want
