import datetime as dt

T0 = dt.datetime(2024, 1, 1)


def hourly(spark, series, start=T0, name="pm25"):
    """{station: [values]} to an hourly table; the value 'gap' leaves the row out."""
    rows = []
    for station, values in series.items():
        for i, x in enumerate(values):
            if x != "gap":
                rows.append((station, start + dt.timedelta(hours=i), None if x is None else float(x)))
    return spark.createDataFrame(rows, f"station_id string, timestamp timestamp, {name} double")


def calendar(spark, series, label=None):
    """{station: [values]} to a daily calendar with positions and an optional label function."""
    rows = []
    for station, values in series.items():
        for i, x in enumerate(values):
            rows.append((station, (T0 + dt.timedelta(days=i)).date(), i, None if x is None else float(x), label(i) if label else 0))
    return spark.createDataFrame(rows, "station_id string, date date, pos long, value double, label long")


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
