"""Digests of files and trees against hashlib."""

import hashlib
import zlib

from beliefline.sources import digests


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain_tree(folder, chunk, children):
    """The digest of a folder from its files, read whole."""
    lines = []
    for p in folder.iterdir():
        if p.is_dir():
            if p.name not in digests.SKIPPED_FOLDERS and any(x.is_file() for x in p.rglob("*")):
                lines.append((p.name, plain_tree(p, chunk, children)))
        elif p.suffix not in digests.SKIPPED_SUFFIXES:
            data = p.read_bytes()
            parts = [sha(data[i : i + chunk]) for i in range(0, max(len(data), 1), chunk)]
            lines.append((p.name, parts[0] if len(parts) == 1 else sha("".join(parts).encode())))
    dealt = {}
    for name, digest in lines:
        dealt.setdefault(zlib.crc32(name.encode()) % -(-len(lines) // children), []).append(f"{name}\t{digest}")
    parts = [f"{i:010d}\t" + sha("\n".join(sorted(rows)).encode()) for i, rows in dealt.items()]
    return sha("\n".join(sorted(parts)).encode())


def test_trees(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {"a.txt": b"x" * 1000, "empty": b"", "sub/b b.bin": bytes(range(256)) * 20, "sub/deep/é.txt": b"abc", "sub/__pycache__/c.pyc": b"no", "top.pyc": b"no", **{f"many/{i:03d}": b"%d" % i for i in range(40)}}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    listed = {r["name"]: (r["bytes"], r["sha256"]) for r in digests.manifest(spark, str(root)).collect()}
    assert len(listed) == 44 and listed["a.txt"] == (1000, sha(b"x" * 1000)) and listed["empty"] == (0, sha(b"")) and "sub/deep/é.txt" in listed
    for chunk, children in ((64 << 20, 1024), (300, 7)):
        assert digests.tree_digest(spark, f"file://{root}", chunk=chunk, children=children) == plain_tree(root, chunk, children)
    before = digests.tree_digest(spark, str(root))
    (root / "sub/deep/é.txt").write_bytes(b"abd")
    assert digests.tree_digest(spark, str(root)) != before


def test_blocks_of_a_range(tmp_path):
    data = bytes(range(251)) * 99
    (tmp_path / "f").write_bytes(data)
    for begin, size in ((0, len(data)), (5, 1000), (24_000, 10**9), (0, 0)):
        assert digests.digest_of(f"file://{tmp_path}/f", begin, size, block=64) == sha(data[begin : begin + size])
