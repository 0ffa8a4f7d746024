"""As many runs as the recall asks for, each with a coordinate of its own."""

from __future__ import annotations

import math

from panelwell.llm.jaccard_join import JoinSettings, sketches


def test_runs_are_not_cut_to_the_coordinates(spark):
    for settings in (JoinSettings(similarity=0.4), JoinSettings(recall=1 - 1e-12, similarity=0.6), JoinSettings()):
        one = settings.similarity * (1 - (1 - settings.similarity) ** 2) ** (settings.depth - 1)
        assert (1 - one) ** settings.runs() <= 1 - settings.recall + 1e-15
        assert settings.width() >= settings.runs()
    settings = JoinSettings(similarity=0.4)
    docs = spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")
    assert settings.runs() > settings.coordinates and math.isfinite(settings.runs())
    assert len(sketches(docs, settings).first()["sketch"]) == settings.runs()
    assert len(sketches(docs, JoinSettings()).first()["sketch"]) == 24
