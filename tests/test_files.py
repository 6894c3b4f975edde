"""Walking, stamping, pruning, merging and culling real trees, through the command lines."""

import os

import pytest

from fingerloom.cli import cull, groups, merge, stamp
from fingerloom.functions import metadata, paths, text
from fingerloom.sources import attributes, walk
from fingerloom.sources.catalog import open_catalog, summary_mismatch


def put(root, name, content="x", mtime=None):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)
    if mtime:
        os.utime(path, (mtime, mtime))
    return path


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    for name in ("B.txt", "a.txt", "Sub/z", "sub2/y", "skip/s", "keep/deep/d"):
        put(root, name, name)
    put(root, "skip/" + walk.MARKER, "")
    os.symlink(os.path.join(root, "a.txt"), os.path.join(root, "link"))
    try:
        os.setxattr(os.path.join(root, "a.txt"), "user.probe", b"1")
        os.removexattr(os.path.join(root, "a.txt"), "user.probe")
    except OSError:
        pytest.skip("no extended attributes here")
    return root


def listed(spark, *args, **kw):
    return [os.path.relpath(r.path, args[0][0]) for r in walk.walk(spark, *args, **kw).orderBy("root_order", "walk_key").collect()]


def test_walk_order_and_gates(spark, tree):
    assert listed(spark, [tree]) == ["a.txt", "B.txt", "keep/deep/d", "Sub/z", "sub2/y"]
    assert listed(spark, [tree], None, False) == ["a.txt", "B.txt", "keep/deep/d", "skip/s", "Sub/z", "sub2/y"]
    assert listed(spark, [tree], ["sub*", "B.*"]) == ["a.txt", "keep/deep/d", "Sub/z"]
    assert walk.root_warnings([tree], ["tree"]) and walk.root_warnings([os.path.join(tree, "skip")], [])
    assert listed(spark, [os.path.join(tree, "a.txt")]) == ["."]


def test_stamp_verify_remove(spark, tree, capsys, tmp_path):
    db = str(tmp_path / "db")
    assert stamp.main(["--sum", "-n", tree], spark) == 0
    assert attributes.get(os.path.join(tree, "a.txt")) is None
    assert stamp.main(["--sum", "--prescan", "--database", db, "--locate", tree], spark) == 0
    doc = metadata.loads(attributes.get(os.path.join(tree, "a.txt")))
    assert doc["digests"] == {"xxh3": attributes.hash_file(os.path.join(tree, "a.txt"))}
    capsys.readouterr()
    rows = {r.rel_path.rsplit("/tree/", 1)[1]: r for r in open_catalog(spark, db, "ro").files().collect()}
    assert set(rows) == {"a.txt", "B.txt", "keep/deep/d", "Sub/z", "sub2/y"}
    assert rows["a.txt"].digest == doc["digests"]["xxh3"] and rows["a.txt"].size == 5
    # A second run finds nothing to do; one without --locate keeps the sizes.
    assert stamp.main(["--sum", "--database", db, tree], spark) == 0
    assert {r.size for r in open_catalog(spark, db, "ro").files().collect()} == {r.size for r in rows.values()}
    assert stamp.main(["--verify", tree], spark) == 2 - 2
    path = os.path.join(tree, "B.txt")
    old = os.stat(path)
    with open(path, "w") as f:
        f.write("evil!")
    os.utime(path, ns=(old.st_atime_ns, old.st_mtime_ns))
    capsys.readouterr()
    assert stamp.main(["--verify", tree], spark) == 1
    assert f"CORRUPT {path}" in capsys.readouterr().out
    put(tree, "a.txt", "edited", 4_000_000_000)
    put(tree, "new", "n")
    assert stamp.main(["--verify", tree], spark) == 1
    out = capsys.readouterr().out
    assert "stale  " in out and "unverifiable" in out
    assert stamp.main(["--db-prescan", "--sum", "--database", db, "-f", tree], spark) == 2
    assert stamp.main(["--remove", tree], spark) == 0
    assert attributes.get(path) is None


def test_prune_and_moves(spark, tree, capsys, tmp_path):
    db = str(tmp_path / "db")
    stamp.main(["--sum", "--database", db, tree], spark)
    assert stamp.main(["--prune-all", "--database", db, tree], spark) == 0
    os.rename(os.path.join(tree, "Sub"), os.path.join(tree, "moved"))
    os.remove(os.path.join(tree, "sub2/y"))
    os.rmdir(os.path.join(tree, "sub2"))
    os.remove(os.path.join(tree, "B.txt"))
    assert stamp.main(["--prune-all", "-n", "--database", db, tree], spark) == 1
    assert stamp.main(["--prune-all", "--database", db, tree], spark) == 1
    left = sorted(r.rel_path.rsplit("/tree/", 1)[1] for r in open_catalog(spark, db, "ro").files().collect())
    assert left == ["a.txt", "keep/deep/d", "moved/z"]
    assert stamp.main(["--prune-all", "--database", db, tree], spark) == 0
    assert stamp.main(["--prune-dirs", "--database", str(tmp_path / "none"), tree], spark) == 2
    assert stamp.main(["--prune-dirs", "--database", db, str(tmp_path / "gone")], spark) == 2


def test_groups(spark, tmp_path, capsys, tree):
    root, db = str(tmp_path / "t2"), str(tmp_path / "db")
    for d in ("p", "q"):
        for n in ("f1", "f2"):
            put(root, f"{d}/{n}", n)
    put(root, "r/f1", "other")
    stamp.main(["--sum", "--database", db, root], spark)
    capsys.readouterr()
    assert groups.main(["--database", db], spark) == 1
    assert groups.main(["--database", db, "--threshold", "0.5"], spark) == 1
    assert groups.main(["--database", db, "--prep", "--min-sim", "0.2", "--threshold", "0.5"], spark) == 0
    out = capsys.readouterr().out
    assert "group 1  (2 directories, best pair 1.000)" in out and "1 group(s), 2 directorie(s)" in out
    assert groups.main(["--database", db, "--threshold", "0.1"], spark) == 1
    assert groups.main(["--database", db, "--sort", "size"], spark) == 1
    assert groups.main(["--database", db, "--sort", "files"], spark) == 0
    assert groups.main(["--database", db, "--compare", f"{root}/p", f"{root}/q"], spark) == 0
    assert "1.0000" in capsys.readouterr().out
    assert groups.main(["--database", db, "--dupes"], spark) == 0
    assert "2 group(s), 4 file(s) total" in capsys.readouterr().out
    assert groups.main(["--database", db, "--ls", f"{root}/p"], spark) == 0
    assert groups.main(["--database", db, "--clean-db"], spark) == 0
    assert groups.main(["--database", db, "--clean-db"], spark) == 0
    assert "nothing to clean" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        groups.main(["--database", db, "--clean-db", "--dupes"], spark)


def test_cull(spark, tmp_path, capsys, tree):
    kept, other, db = str(tmp_path / "kept"), str(tmp_path / "other"), str(tmp_path / "db")
    put(kept, "d/a", "same")
    put(kept, "d/b", "kept only")
    put(other, "d/renamed", "same")
    put(other, "d/unique", "unique")
    put(other, "e/a", "same")  # another directory: no witness
    put(other, "f/.DS_Store", "")
    put(kept, "g/x", "gone soon")
    put(other, "g/x", "gone soon")
    stamp.main(["--sum", "--locate", "--database", db, kept, other], spark)
    put(other, "d/unstamped", "same")
    capsys.readouterr()
    assert cull.main(["--database", db, "-n", kept, other], spark) == 1
    assert "might delete " + os.path.join(other, "d/renamed") in capsys.readouterr().out
    assert cull.main(["--database", db, kept, other], spark) == 1
    assert os.path.exists(os.path.join(other, "d/renamed"))
    assert cull.main(["--database", db, "--delete", kept, other], spark) == 1
    left = sorted(os.path.relpath(os.path.join(d, f), other) for d, _, fs in os.walk(other) for f in fs)
    assert left == ["d/unique", "d/unstamped", "e/a"] and not os.path.exists(os.path.join(other, "g"))
    assert cull.main(["--database", db, kept, kept + "/d"], spark) == 2
    assert cull.main(["--database", db, kept, str(tmp_path / "nowhere")], spark) == 2


def test_nothing_below_a_fence_is_touched(spark, tmp_path, capsys, tree):
    kept, other, db = str(tmp_path / "kept"), str(tmp_path / "other"), str(tmp_path / "db")
    for side in (kept, other):
        put(side, "a/b/copy", "same")
        put(side, "x/copy", "also")
        put(side, "x/y/z/copy", "deep")
    put(other, "a/b/.DS_Store", "")
    put(other, "x/.DS_Store", "")
    put(other, "x/y/.DS_Store", "")
    put(other, "only/here/.DS_Store", "")
    os.symlink("copy", os.path.join(other, "x/link"))
    os.symlink("/etc", os.path.join(other, "absolute"))
    stamp.main(["--sum", "--locate", "--database", db, kept, other], spark)
    put(other, "a/" + walk.MARKER, "")
    put(other, "odd/.DS_Store", "")
    os.mkfifo(os.path.join(other, "odd/pipe"))
    capsys.readouterr()
    assert cull.main(["--database", db, kept, other], spark) == 1
    out = capsys.readouterr().out
    assert f"would delete {other}/x/copy" in out and f"would rmdir {other}/x/y/z/" in out and f"would sweep {other}/x/link" in out and f"{other}/a" not in out.replace(f"{other}/absolute", "")
    assert "would sweep:   4 items" in out and "would remove:  5 directories" in out and "fenced:        1 directory" in out
    assert os.path.exists(os.path.join(other, "x/y/z/copy"))
    assert cull.main(["--database", db, "--delete", kept, other], spark) == 1
    out = capsys.readouterr().out
    assert "deleted:       2 files" in out and "swept:         4 items" in out and "removed:       5 directories" in out
    left = sorted(os.path.relpath(os.path.join(d, n), other) for d, folders, names in os.walk(other) for n in folders + names)
    assert left == ["a", "a/@fingerloom-ignore", "a/b", "a/b/.DS_Store", "a/b/copy", "absolute", "odd", "odd/.DS_Store", "odd/pipe"]
    rows = {r.rel_path.rsplit("/other/", 1)[1] for r in open_catalog(spark, db, "ro").files().collect() if "/other/" in r.rel_path}
    assert rows == {"a/b/copy", "a/b/.DS_Store"}
    put(other, walk.MARKER, "")
    assert cull.main(["--database", db, "--delete", kept, other], spark) == 0
    assert "nothing to do" in capsys.readouterr().err


def test_missing_roots_and_folders(spark, tree, tmp_path, monkeypatch):
    gone = str(tmp_path / "gone")
    assert walk.walk(spark, [gone, tree]).count() == 5 and walk.walk(spark, [gone]).count() == 0
    assert stamp.main(["--sum", gone, tree], spark) == 0
    reader = walk.WalkReader({"roots": f'["{tree}"]'})
    assert list(reader.read(walk.WalkPartition(0, tree, gone, True))) == []
    monkeypatch.setattr(walk, "SPLIT", 3)  # a division that cuts subtrees finds the same files
    parts = walk.WalkReader({"roots": f'["{tree}"]'}).partitions()
    assert sorted(r[2] for p in parts for r in reader.read(p)) == sorted(r.path for r in walk.walk(spark, [tree]).collect())
    assert {deep for _, deep in walk.divided(tree, True, [])} == {True, False}


def test_overlapping_roots_and_two_digests_give_one_row(spark, tree, tmp_path):
    db = str(tmp_path / "db")
    path = os.path.join(tree, "a.txt")
    stamp.main(["--sum", tree], spark)
    doc = metadata.loads(attributes.get(path))
    doc["digests"] = doc["digests"] | {"md5": "d41d8"}
    attributes.put(path, metadata.dumps(doc))
    for _ in range(2):
        stamp.main(["--import", "--locate", "--database", db, tree, os.path.join(tree, "keep"), tree], spark)
        rows = open_catalog(spark, db, "ro").files().collect()
        assert len(rows) == 5 == len({r.rel_path for r in rows})
        assert {r.algo for r in rows if r.rel_path.endswith("a.txt")} == {"md5"}
    assert [r.path for r in open_catalog(spark, db, "ro").mounts().collect()] == [walk.mount_of(tree)]


def test_links_and_offline_sides(tmp_path):
    root = str(tmp_path / "c")
    put(root, "d/a", "x")
    for name, target in (("in", "d/a"), ("dangling", "gone/x"), ("out", "../outside"), ("abs", root + "/d/a"), ("up", "../c/d")):
        os.symlink(target, os.path.join(root, name))
    assert {n for n in ("in", "dangling", "out", "abs", "up", "d/a") if cull.sweepable_link(os.path.join(root, n), root)} == {"in", "dangling", "up"}
    rows = {("/vol/x", "t"), ("/vol", "x/t/u")}
    has = lambda m, r: (m, r) in rows
    assert cull.side_offline("/vol/x/t", ["/", "/vol", "/vol/x"], has) == cull.Side("/vol/x/t", "/vol/x", "t")
    assert cull.side_offline("/vol/x/t/u", ["/", "/vol", "/vol/x"], has) == cull.Side("/vol/x/t/u", "/vol", "x/t/u")
    assert cull.side_offline("/none", ["/vol/x"], has).mount == "/vol/x" and cull.side_offline("/none", [], has) is None
    assert cull.overlapping(cull.Side("a", "/m", ""), cull.Side("b", "/m", "x")) and not cull.overlapping(cull.Side("a", "/m", "x"), cull.Side("b", "/m", "xy"))


def test_merge(spark, tmp_path, capsys):
    from fingerloom.sources.catalog import FILES_SCHEMA

    def make(name, rows, algo="xxh3"):
        path = str(tmp_path / name)
        full = [(m, r, 1, algo, d, "t", "t", "t", "1.0.0", *[None] * 9) for m, r, d in rows]
        open_catalog(spark, path).write("files", spark.createDataFrame(full, FILES_SCHEMA))
        return path

    one, two = make("one", [("/a", "x", "d1"), ("/a", "y", "d2")]), make("two", [("/b", "z", "d3")])
    clash, mixed = make("clash", [("/a", "q", "d4")]), make("mixed", [("/c", "q", "d4")], "md5")
    target = str(tmp_path / "target")
    assert merge.main(["--into", target, "-n", one], spark) == 1 and not os.path.exists(target)
    assert merge.main(["--into", target, one, mixed], spark) == 2 and not os.path.exists(target)
    assert merge.main(["--into", target, one, clash], spark) == 2
    assert merge.main(["--into", target, one, one], spark) == 2
    assert merge.main(["--into", one, one], spark) == 2
    assert merge.main(["--into", target, str(tmp_path / "nothing")], spark) == 2
    assert merge.main(["--into", target, one, two], spark) == 1
    assert merge.main(["--into", target, clash], spark) == 1
    got = sorted((r.mount, r.rel_path, r.digest) for r in open_catalog(spark, target, "ro").files().collect())
    assert got == [("/a", "q", "d4"), ("/b", "z", "d3")]
    # A source that knows a mount without rows clears it; derived tables go.
    empty = make("empty", [])
    open_catalog(spark, empty).write("mounts", spark.createDataFrame([(1, "/a"), (2, "/new")], "id long, path string"))
    open_catalog(spark, target).write("pairs", spark.range(1))
    capsys.readouterr()
    assert merge.main(["--into", target, "-n", empty], spark) == 1
    assert "would replace: 1 rows" in capsys.readouterr().out and open_catalog(spark, target).has("pairs")
    assert merge.main(["--into", target, empty], spark) == 1
    assert "drop: 1 derived tables" in capsys.readouterr().out and not open_catalog(spark, target).has("pairs")
    assert [(r.mount, r.rel_path) for r in open_catalog(spark, target, "ro").files().collect()] == [("/b", "z")]
    assert {r.path for r in open_catalog(spark, target, "ro").mounts().collect()} == {"/a", "/b", "/new"}
    assert merge.main(["--into", target, empty], spark) == 0


REJECTED = [
    "d", "--prescan d", "-q -v --sum d", "-f -n --sum d", "--import d", "--locate d", "--database x d", "--verify --database x --sum d", "--verify --sum d", "--verify -f d",
    "--remove --sum d", "--remove --verify d", "--remove -f d", "--prune-dirs d", "--prune-all --database x --sum d", "--prune-dirs --database x -f d", "--prune-dirs --database x --prescan d",
    "--prescan --remove d", "--db-prescan --sum d", "--db-prescan --prescan --sum --database x d", "--sum",
]
ACCEPTED = ["--sum d", "--sum --import --database x d", "--verify -n d", "--remove -n d", "-f --import --database x d", "--locate --database x d", "--prune-dirs --prune-all --database x --exclude p d", "--sum -vv d e", "--db-prescan --sum --database x d"]


@pytest.mark.parametrize("line", REJECTED)
def test_rejected(line):
    p = stamp.parser()
    with pytest.raises(SystemExit) as e:
        stamp.validate(p.parse_args(line.split()), p)
    assert e.value.code == 2


@pytest.mark.parametrize("line", ACCEPTED)
def test_accepted(line):
    p = stamp.parser()
    stamp.validate(p.parse_args(line.split()), p)


def test_progress_and_quiet():
    p = stamp.parser()
    for line, quiet, progress in (("--sum -q --progress d", 0, True), ("--sum --progress -fq d", 1, False), ("--sum --progress d", 0, True)):
        args = p.parse_args(line.split())
        stamp.settle_quiet(args)
        assert (args.quiet, args.progress) == (quiet, progress)


def test_text():
    assert [text.human_size(n) for n in (0, 1023, 1024, 1536, 1023.9 * 1024, 1024**5 * 1024)] == ["0B", "1023B", "1.0KiB", "1.5KiB", "1024KiB", "1024PiB"]
    assert [text.human_size(n, True) for n in (999, 1000)] == ["999B", "1.0kB"]
    assert text.report_size(1023.9 * 1024) == "1023.9KiB" and text.report_size(5) == "5B"
    assert [text.eta(s) for s in (45, 312, 3900)] == ["45s", "5m12s", "1h05m"] and text.elapsed(3725.9) == "1:02:05"
    assert [text.human_count(n) for n in (5, 1500, 2_500_000, 3e9)] == ["5", "1.5k", "2.50M", "3.00G"]
    assert text.percent(1, 0) == "(100%)" and text.percent(1, 8) == "( 12%)"
    assert text.prescan_prefix(3, 120, 0, 2048) == "003/120 (  2%)  0B/2.0KiB (  0%)  "
    assert text.render_bar(0.5, 4) == "[##--]"


def test_metadata():
    assert [metadata.iso_ns(n) for n in (0, 999, 1999)] == ["1970-01-01T00:00:00.000000Z", "1970-01-01T00:00:00.000000Z", "1970-01-01T00:00:00.000001Z"]
    assert metadata.iso_ns(-1) == "1969-12-31T23:59:59.999999Z"
    doc = metadata.build("d", "m", "h", "r")
    assert metadata.loads(metadata.dumps(doc)) == doc and metadata.major_of("12.3.4") == 12
    for raw in (None, b"\xff", b"[]", b"{", b'{"version": "1"}', metadata.dumps(doc | {"digests": []})):
        assert metadata.loads(raw) is None


def test_hash_vectors(tmp_path):
    for size in (0, 1, (1 << 20) - 1, 1 << 20, (1 << 20) + 1):
        path = tmp_path / "f"
        path.write_bytes(b"q" * size)
        import xxhash

        seen = []
        assert attributes.hash_file(str(path), progress=seen.append) == xxhash.xxh3_64_hexdigest(b"q" * size)
        assert sum(seen) == size
    path.write_bytes(b"")
    assert {a: attributes.hash_file(str(path), a) for a in attributes.HASHERS} == metadata.EMPTY_DIGESTS
    with pytest.raises(ValueError):
        attributes.hash_file(str(path), "crc")


def test_catalog_values(spark, tmp_path):
    with pytest.raises(NotImplementedError):
        open_catalog(spark, "mysql://host/db")
    with pytest.raises(FileNotFoundError):
        open_catalog(spark, str(tmp_path / "no"), "ro")
    assert open_catalog(spark, str(tmp_path / "mysql:host")).path.endswith("mysql:host")
    base = {"roots": ["/a"], "sum_mode": True, "force": False, "exclude": ["x", "y"], "no_ignore": False}
    assert summary_mismatch(base, base | {"exclude": ["y", "x"]}) is None
    assert summary_mismatch(base, base | {"force": True, "no_ignore": True}) == "different --force"


@pytest.mark.parametrize("pattern,name,hit", [("*.log", "a.log", True), ("*.log", "A.LOG", False), ("d?", "d1", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a/b", "a", False), ("[", "[", True), ("a.b", "axb", False), ("[]]", "]", True)])
def test_globs(pattern, name, hit):
    import fnmatch
    import re

    assert bool(re.match(paths.glob_regex(pattern), name)) == hit == fnmatch.fnmatchcase(name, pattern)
