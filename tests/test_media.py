"""Sources of files: pages, images, audio, phrases, installed files."""

import numpy as np
import pytest

from foliant.sources import media


def test_converted_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one|two|three")
    (tmp_path / "b.bin").write_bytes(b"only")
    pages = media.converted_pages(spark, str(tmp_path), lambda data: data.decode().split("|"))
    got = sorted((r["name"].rpartition("/")[2], r["page_number"], r["markdown"]) for r in pages.collect())
    assert got == [("a.bin", 1, "one"), ("a.bin", 2, "two"), ("a.bin", 3, "three"), ("b.bin", 1, "only")]
    media.check_page_counts(pages, pages.select("name"))
    with pytest.raises(ValueError, match="page counts"):
        media.check_page_counts(pages, pages.where("page_number = 1").select("name"))


def test_images_that_are_missing_or_damaged_are_null(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "ok.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"rest")
    (tmp_path / "bad.png").write_bytes(b"no image")
    wanted = spark.createDataFrame([("x/ok.png",), ("bad.png",), ("none.png",)], "path string")
    got = {r["path"]: r["content"] for r in media.image_bytes(spark, str(tmp_path), wanted).collect()}
    assert bytes(got["x/ok.png"]).endswith(b"rest") and got["bad.png"] is None and got["none.png"] is None


def test_audio_blocks(spark):
    data = np.arange(-2000, 2000, dtype="<i2")
    files = spark.createDataFrame([("a", data.tobytes()), ("b", b""), ("c", None)], "path string, content binary")
    rows = media.pcm_blocks(files).withColumn("scaled", media.scaled("samples")).orderBy("block").collect()
    assert [(r["path"], r["block"], len(r["samples"])) for r in rows] == [("a", 0, 1600), ("a", 1, 1600), ("a", 2, 800)]
    assert rows[0]["samples"][0] == -2000 and rows[0]["scaled"][0] == pytest.approx(-2000 / 32768)


def test_phrases_tokens_and_installed_files(spark, tmp_path):
    (tmp_path / "words.txt").write_text("tire pressure\n\n jump start \n")
    assert [tuple(r) for r in media.phrases(spark, f"{tmp_path}/words.txt").collect()] == [("tire pressure", 1.3), ("jump start", 1.3)]
    (tmp_path / "tokens.txt").write_text("<blk> 0\n▁the 1\n")
    assert [tuple(r) for r in media.token_table(spark, f"{tmp_path}/tokens.txt").collect()] == [("<blk>", 0), ("▁the", 1)]
    (tmp_path / "m.bin").write_bytes(b"12345")
    target = f"file://{tmp_path}/to/m.bin"
    assert media.install_file(spark, f"file://{tmp_path}/m.bin", target, 5) and not media.install_file(spark, f"file://{tmp_path}/m.bin", target, 5)
    (tmp_path / "m.bin").write_bytes(b"123456")
    with pytest.raises(ValueError, match="6 bytes"):
        media.install_file(spark, f"file://{tmp_path}/m.bin", target, 7)
    assert (tmp_path / "to" / "m.bin").read_bytes() == b"12345" and not (tmp_path / "to" / "m.bin.part").exists()
    assert media.install_file(spark, f"file://{tmp_path}/m.bin", target, 6) and (tmp_path / "to" / "m.bin").read_bytes() == b"123456"
