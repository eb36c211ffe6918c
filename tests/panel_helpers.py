"""What several test files share beside the fixtures."""


def column(df, name, by=("code", "date")):
    return [r[name] for r in df.orderBy(*by).collect()]
