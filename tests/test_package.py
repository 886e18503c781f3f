"""The training-data operators are optional: nothing else imports them, and the rest works without them."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_optional_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "concordat")):
        for name in names:
            path = os.path.join(folder, name)
            if name.endswith(".py") and f"{os.sep}llm{os.sep}" not in path:
                text = open(path, encoding="utf-8").read()
                assert not re.search(r"^\s*(?:from|import)\s.*\b(?:llm|corpus_pipeline)\b", text, re.M), path


def test_entry_points_without_the_optional_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('concordat.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q, o = e.queries(), e.oracle_sql()\n"
        "assert q and set(q) == set(o) and not any(n.startswith('op') for n in q), sorted(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
