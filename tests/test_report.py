from helpers import rows

from logquarry.functions import patterns as P
from logquarry.operators.report import assemble_reports


def reports(spark, cases):
    """cases: (question, result, diagnosis, warnings) -> report texts in order."""
    q = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "question_id long, question string")
    r = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases) if c[1] is not None], "question_id long, result string")
    d = spark.createDataFrame([(i, c[2]) for i, c in enumerate(cases) if c[2] is not None], "question_id long, analysis string")
    w = spark.createDataFrame(
        [(i, p, t) for i, c in enumerate(cases) for p, t in enumerate(c[3])], "question_id long, pos int, warning string"
    ).repartition(3)
    return [t for _, t in sorted(rows(assemble_reports(q, d, r, w)))]


def test_sections(spark):
    found = reports(
        spark,
        [
            ("which night had most restarts?", "Tuesday: 8", None, []),
            ("what stopped the import?", None, "*disk full* on `loader_2`", []),
            (" slowest jobs, and their cause ", "import: 12 s", "swap in use", ["retried", "slow"]),
            ("will it rain?", None, None, []),
            ("will it rain?", "", "", []),
            ("", "41 rows", None, []),
            (" \t ", None, None, ["x"]),
            (None, None, None, []),
            ("did ola@post.example.org log in?", "by a@b.cc", "from 172.16.0.9", ["key secret=k3y-0f_sixteen-or-more"]),
        ],
    )
    assert found == [
        "# which night had most restarts?\n\n## Query Results\nTuesday: 8",
        "# what stopped the import?\n\n## Root Cause Analysis\n*disk full* on `loader_2`",
        "# slowest jobs, and their cause\n\n## Root Cause Analysis\nswap in use\n\n## Query Results\nimport: 12 s\n\n## Warnings\n- retried\n- slow",
        "# will it rain?\n\n" + P.NO_RESULTS,
        "# will it rain?\n\n" + P.NO_RESULTS,
        "# Question\n\n## Query Results\n41 rows",
        "# Question\n\n" + P.NO_RESULTS + "\n\n## Warnings\n- x",
        "# Question\n\n" + P.NO_RESULTS,
        "# did [REDACTED_EMAIL] log in?\n\n## Root Cause Analysis\nfrom [REDACTED_IP]\n\n## Query Results\nby [REDACTED_EMAIL]"
        "\n\n## Warnings\n- key secret=[REDACTED_API_KEY]",
    ]


def test_warnings_keep_their_order(spark):
    (text,) = reports(spark, [("q", None, None, [f"w{i}" for i in range(30)])])
    assert text.split("## Warnings\n")[1].split("\n") == [f"- w{i}" for i in range(30)]
