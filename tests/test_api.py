import pytest

from regspark.api import Tree
from regspark.schema import Limits

REG = 'Windows Registry Editor Version 5.00\n\n[HKEY_LOCAL_MACHINE\\Soft\\App]\n@="d"\n"Name"="x"\n"N"=dword:0000000a\n[HKEY_LOCAL_MACHINE\\Soft\\App\\Sub]\n"B"=hex:01,02\n'


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("reg") / "a.reg"
    p.write_text(REG)
    return Tree.from_reg(spark, str(p))


def test_lookup(tree):
    assert [r.path for r in tree.list_keys().collect()] == ["Soft", "Soft\\App", "Soft\\App\\Sub"]
    assert tree.get("hklm/soft/app", "n").first()["dword_val"] == 10
    assert [r.name for r in tree.list_values("Soft\\App").collect()] == ["", "N", "Name"]
    keys, values = tree.search("sub")
    assert keys.count() == 1 and values.count() == 0
    assert tree.stats()["totals"].first()["n_values"] == 4
    assert tree.stat().where("path = 'Soft'").first()["subkey_n"] == 1


def test_change(tree):
    t = tree.set("Soft\\App", "NAME", "SZ", "y").delete_value("Soft\\App", "N").create_key("New\\Key")
    assert t.get("soft\\app", "name").first()["string_val"] == "y"
    kd, vd = tree.diff(t)
    assert {(r.path, r.status) for r in kd.where("status <> 'unchanged'").collect()} == {("New", "added"), ("New\\Key", "added"), ("Soft\\App", "modified")}
    with pytest.raises(ValueError):
        tree.delete_key("Soft")
    assert tree.delete_key("Soft", recursive=True).keys.count() == 0


def test_image(spark, tree):
    images = tree.images().selectExpr("hive_id as path", "image as content")
    back = Tree.from_images(images, tolerant=False)
    assert {r.path for r in back.keys.collect()} == {r.path for r in tree.keys.collect()}
    assert tree.diff(back)[1].where("status <> 'unchanged'").count() == 0
    assert all(r.holds for r in back.verify().collect())
    assert back.diagnose().where("severity <> 'info'").count() == 0
    assert back.info().first()["clean"] and back.cells()["kinds"].count() > 3
    k, v = back.layout()
    assert k.count() == 4 and {r.storage for r in v.collect()} == {"inline"}


def test_link_and_limits(tree):
    linked = tree.link(tree, "Mnt")
    assert linked.keys.count() == 7 and linked.values.count() == 8
    assert {r.rule for r in tree.validate(Limits(depth=2, value_size=3)).collect()} == {"depth", "value_size"}
