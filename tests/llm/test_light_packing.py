"""Small caches and slices change no row."""

from ravelin.llm import packing, tokens


def test_light_packing_gives_the_same_rows(spark, messy, monkeypatch):
    monkeypatch.setattr(tokens, "_LIGHT_PARTS", 5)
    monkeypatch.setattr(tokens, "_LIGHT_NEW", 7)
    docs = messy.where("doc_id IS NOT NULL").coalesce(1)
    rows = lambda light: sorted(map(tuple, packing.pack(docs, light=light).drop("sequence_id").collect()))
    assert rows(True) == rows(False)
