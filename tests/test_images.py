import struct

import numpy as np
import pytest

from mesoflow.sources import frames as S

RNG = np.random.default_rng(2)


def pgm(img):
    return b"P5\n# c\n%d %d\n%d\n" % (img.shape[1], img.shape[0], 65535 if img.dtype == np.uint16 else 255) + img.astype(">u2" if img.dtype == np.uint16 else "u1").tobytes()


def tiff(img):
    import struct

    data = img.astype("<u2").tobytes()
    tags = [(256, 4, img.shape[1]), (257, 4, img.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(data))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd


def test_files_are_read_in_numeric_order_with_stride(spark, tmp_path):
    imgs = {k: RNG.integers(0, 60000, (6, 9)).astype(np.uint16) for k in (1, 2, 10, 11, 12)}
    for k, img in imgs.items():
        name, data = (f"a_{k}.pgm", pgm(img)) if k % 2 else (f"a_{k}.tif", tiff(img))
        (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("x")
    got = {r["frame"]: np.frombuffer(r["px"], np.float32).reshape(r["h"], r["w"]) for r in S.read_frames(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 10, 11, 12] and all((got[k] == imgs[k]).all() for k in imgs)
    assert sorted(r["frame"] for r in S.read_frames(spark, str(tmp_path), stride=2, most=2).collect()) == [1, 10]
    with pytest.raises(ValueError):
        S.decode_pgm(b"P2\n1 1\n255\n0")


def test_stack_source_reads_ranges(spark, tmp_path):
    stack = RNG.uniform(size=(23, 4, 5)).astype(np.float32)
    np.save(tmp_path / "s.npy", stack)
    spark.dataSource.register(S.FrameStack)
    read = lambda **o: spark.read.format("framestack").options(path=str(tmp_path / "s.npy"), **o).load()
    df = read(chunk="5")
    assert df.rdd.getNumPartitions() == 5
    assert all((np.frombuffer(r["px"], np.float32).reshape(4, 5) == stack[r["frame"]]).all() for r in df.collect())
    assert sorted(r["frame"] for r in read(first="3", last="6").collect()) == [3, 4, 5, 6]


def test_other_decoders_are_tried():
    img = RNG.integers(0, 255, (4, 5)).astype(np.uint16)
    assert (S.decode("x.tif", pgm(img)) == img).all() and (S.decode("x.unknown", tiff(img)) == img).all()
    with pytest.raises(ValueError, match="no decoder"):
        S.decode("x.pgm", b"nothing")


@pytest.mark.parametrize("odd", [None, 2])
def test_a_wrong_landing_falls_back_to_the_start(spark, tmp_path, odd):
    """Ranges of a stream of numbered images; with one image of another size reckoned places are wrong."""
    imgs = [RNG.integers(0, 255, (4, 7 if k == odd else 5)).astype(np.uint8) for k in range(23)]
    data = b"".join(b"P5\n#frame %02d\n%d %d\n255\n" % (k, i.shape[1], i.shape[0]) + i.tobytes() for k, i in enumerate(imgs))
    data = data.replace(b"frame 0", b"frame ")
    (tmp_path / "s.pgms").write_bytes(data)
    spark.dataSource.register(S.FrameStack)
    rows = spark.read.format("framestack").options(path=str(tmp_path / "s.pgms"), chunk="5").load().collect()
    got = {r["frame"]: np.frombuffer(r["px"], np.float32).reshape(r["h"], r["w"]) for r in rows}
    assert len(rows) == 23 and all((got[k] == i).all() for k, i in enumerate(imgs))
