"""Every shot of a long text leaves its time."""

from sightline.llm import media


def test_all_cuts_are_listed(spark):
    text = "".join(c * 8192 for c in "a~" * 12)
    feature = media.stored_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().feature
    facts = dict(f.split("=") for f in feature.split(";"))
    assert int(facts["shots"]) > 9 and len(facts["cuts"].split(",")) == int(facts["shots"]) - 1
