"""What the entry module does when parts of the repository are missing or broken."""

import pytest

import __spark_entry__ as entry


def test_missing_parts_are_left_out_and_broken_ones_raise(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "whole_part").mkdir()
    (tmp_path / "whole_part" / "__init__.py").write_text("")
    (tmp_path / "whole_part" / "fine.py").write_text("value = 3")
    (tmp_path / "whole_part" / "broken.py").write_text("import no_such_module_anywhere")
    assert entry.optional("whole_part.fine", "whole_part").value == 3
    assert entry.optional("missing_part.queries", "missing_part") is None
    assert entry.optional("whole_part.gone", "whole_part") is None
    with pytest.raises(ModuleNotFoundError, match="no_such_module_anywhere"):
        entry.optional("whole_part.broken", "whole_part")


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
