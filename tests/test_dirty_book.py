"""The dirty book breaks every rule, so no quality query is compared on zeros only."""

import pytest

from loanscope.plans import dirty
from tools.check_oracle import duck

from book_paths import SF_CHECK, SF_SMALL


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_every_rule_is_broken_somewhere(sf):
    con = duck(sf)
    for name, sql in dirty.oracle().items():
        rows = con.sql(sql).fetchall()
        assert rows, name
        if name.endswith("_rules") or name in ("dq_fk_violations", "dq_duplicate_keys", "dq_orphan_loans",
                                               "dq_orphan_repayments", "dq_future_dates", "dq_lenient_parse"):
            for r in rows:
                numbers = [v for v in r if isinstance(v, int)]
                assert numbers and all(v > 0 for v in numbers), (name, r)
