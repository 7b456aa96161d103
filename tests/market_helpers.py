"""What several test modules of the market operators share."""

import datetime

SF = "/root/testdata/sf0.001"


def bars(spark, closes, symbol="A", volumes=None, highs=None, lows=None, opens=None, timeframe="1h"):
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for i, c in enumerate(closes):
        rows.append((symbol, timeframe, t0 + datetime.timedelta(hours=i), float(opens[i] if opens is not None else c),
                     float(highs[i] if highs is not None else c + 1), float(lows[i] if lows is not None else c - 1), float(c),
                     float(volumes[i] if volumes is not None else 100 + i)))
    return spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double")
