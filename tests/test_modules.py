"""Module facts and architecture rules on a small hand-made tree."""

from tidemark.operators import python_modules as pm

API = """from fastapi import Depends
import os

@router.get("/a")
def a(s=Depends(get_service)):
    return UserService()

@router.get("/b")
def b():
    return UserService().all() + get_db()

def c():
    return os.getenv("X"), os.environ.get("Y")
"""
GOD = """import sqlalchemy, jwt, subprocess
from pydantic_settings import BaseSettings
@app.get("/x")
def x(): pass
def f1(): pass
def f2(): pass
def f3(): pass
def f4(): pass
def f5(): pass
class Everything:
""" + "".join(f"    def {m}(self): pass\n" for m in ("handle_a", "save_b", "login_c", "d", "e", "f", "g", "h", "i", "j"))
FILES = [
    ("app/api/users.py", API), ("app/core/config.py", "import os\nX = os.getenv('X')\n"), ("app/services/s.py", "from app.core import config\n"), ("app/models/m.py", "from core.config import X\n"),
    ("app/utils/u.py", "import app.core.config\n"), ("app/big.py", GOD), ("app/bad.py", "def ("), ("tests/api/t.py", API), ("app/none.py", None),
]


def modules(spark, files):
    return pm.python_modules(spark.createDataFrame([(p, "python", t) for p, t in files], "path string, language string, content string"))


def test_facts(spark):
    got = {r.file: r for r in modules(spark, FILES).collect()}
    assert set(got) == {p for p, _ in FILES} - {"app/bad.py", "tests/api/t.py"}
    assert got["app/big.py"].duties == ["auth_security", "config_management", "persistence_db", "routing_http", "system_io"]
    assert (got["app/big.py"].n_functions, got["app/big.py"].n_classes, got["app/api/users.py"].layer, got["app/core/config.py"].module) == (16, 1, "api", "app.core.config")
    assert got["app/none.py"].loc == 0 and got["app/none.py"].duties == []


def test_rules(spark):
    m = modules(spark, FILES)
    assert tuple(pm.config_convention(m).first()) == (3, 7, True)
    got = sorted((r.rule_id, r.file, r.line_start, r.symbol) for r in pm.module_findings(m).collect())
    assert got == [
        ("ENT-ARCH-003", "app/api/users.py", 10, "UserService"),
        ("ENT-ARCH-003", "app/api/users.py", 10, "get_db"),
        ("ENT-ARCH-004", "app/api/users.py", 13, "env:13"),
        ("ENT-ARCH-004", "app/api/users.py", 13, "env:13"),
        ("ENT-ARCH-005", "app/big.py", 1, "app.big"),
        ("ENT-ARCH-006", "app/big.py", 10, "Everything"),
    ]


def test_dependencies(spark):
    files = [*FILES, ("app/core/__init__.py", "from . import config\nfrom .services.s import x\n"), ("app/services/t.py", "from ..core.config import X\nfrom . import s, none\ndef f():\n    import jwt\n"), ("app/v.py", "import bad\nimport app.bad\n")]
    df = spark.createDataFrame([(p, "python", t) for p, t in files], "path string, language string, content string")
    got = {(r.src, r.target, r.external) for r in pm.module_dependencies(df).collect()}
    local = {(s, t) for s, t, _ in got if t}
    assert local == {
        ("app.services.s", "app.core"), ("app.models.m", "app.core.config"), ("app.utils.u", "app.core.config"), ("app.services.t", "app.core.config"), ("app.services.t", "app.services.s"),
        ("app.core", "app.services.s"),
    }
    assert {(s, e) for s, _, e in got if e} >= {("app.api.users", "fastapi"), ("app.big", "jwt"), ("app.v", "bad"), ("app.v", "app"), ("app.services.t", "none"), ("app.core", "config")}
    assert ("app.services.t", None, "jwt") not in got and pm.module_dependencies(df.limit(0)).count() == 0


def test_without_a_convention_the_environment_may_be_read(spark):
    found = pm.module_findings(modules(spark, FILES[:1] + [(f"app/x{i}.py", "") for i in range(9)]))
    assert {r.rule_id for r in found.collect()} == {"ENT-ARCH-003"}
    assert pm.module_findings(modules(spark, FILES).limit(0)).count() == 0


LAYERS = [
    ("app/main.py", "from fastapi import FastAPI\nfrom app.api import a, b\nfrom app.repositories import r\nfrom app.services import s\nfrom app.models import m\nfrom app.config import settings\napp = FastAPI()\n"),
    ("app/api/a.py", "import os\nfrom app.services import s\nfrom app.repositories import r\n"),
    ("app/api/b.py", "from app.services.s import f\n"),
    ("app/api/c.py", "from app.services import s\n"),
    ("app/api/d.py", "def f(cursor):\n    cursor.execute('x')\n"),
    ("app/services/s.py", "from app.repositories.r import g\nfrom app.models import m\nfrom app.config import settings\nfrom app.utils import u\n"),
    ("app/repositories/r.py", "from app.models import m\n"),
    ("app/models/m.py", "import json\nfrom app.repositories import r\n"),
    ("app/config/settings.py", ""),
    ("app/utils/u.py", "def f():\n    from app.services import s\n"),
]


def test_dependency_rules(spark):
    def run(files):
        df = spark.createDataFrame([(p, "python", t) for p, t in files], "path string, language string, content string")
        return sorted((r.rule_id, r.file, r.line_start, r.line_end, r.symbol, r.title) for r in pm.architecture_findings(df).where("rule_id in ('ENT-ARCH-001', 'ENT-ARCH-002', 'ENT-ARCH-007', 'ENT-ARCH-008')").collect())

    got = run(LAYERS)
    assert [g[:5] for g in got] == [
        ("ENT-ARCH-001", "app/models/m.py", 2, 2, "app.models.m"),
        ("ENT-ARCH-002", "app/api/a.py", 3, 3, "app.api.a"),
        ("ENT-ARCH-007", "app/services/s.py", 1, 4, "app.services.s"),
        ("ENT-ARCH-008", "app/api/d.py", 1, 2, "app.api.d"),
    ]
    assert got[0][5] == "Circular Module Dependency (2 Modules in Cycle)" and "Across 4 " in got[2][5]
    assert run([f for f in LAYERS if "services" not in f[0] and "models" not in f[0]]) == []
