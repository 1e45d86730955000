import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from riskflow.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("riskflow-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


TX_SCHEMA = ("transaction_id string, ts timestamp_ntz, from_bank int, from_account string, to_bank int, to_account string, "
             "amount_paid decimal(18,2), payment_currency string, amount_received decimal(18,2), receiving_currency string, "
             "payment_format string, is_laundering int")


@pytest.fixture(scope="session")
def make_tx(spark):
    from datetime import datetime
    from decimal import Decimal

    def build(rows):
        """rows: (id, 'YYYY-MM-DD HH:MM:SS', sender, receiver, amount, label)"""
        out = [(i, datetime.fromisoformat(t), 1, a, 2, b, Decimal(str(x)).quantize(Decimal("0.01")), "USD",
                Decimal(str(x)).quantize(Decimal("0.01")), "USD", "ACH", y) for i, t, a, b, x, y in rows]
        return spark.createDataFrame(out, TX_SCHEMA)

    return build
