"""python -m discloq CHUNKS QUERY [-k N] [--mode M] [--company C ...] [--kind K ...]: an answer as JSON."""

import argparse
import json

from discloq.plans.engine import MODES, Engine
from discloq.session import local_session


def main(argv: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="discloq")
    ask.add_argument("chunks", help="Parquet table of chunks")
    ask.add_argument("query")
    ask.add_argument("-k", type=int, default=8)
    ask.add_argument("--mode", choices=MODES, default="bm25")
    ask.add_argument("--company", nargs="*", default=[])
    ask.add_argument("--kind", nargs="*", default=[])
    got = ask.parse_args(argv)
    spark = local_session()
    asked = spark.createDataFrame([("q", got.query)], "qid string, text string")
    base = "hybrid" if got.mode == "hybrid" else "bm25"
    more = {"base": base} if "cover" in got.mode else {}
    row = Engine(spark.read.parquet(got.chunks)).answer(asked, got.mode, got.k, companies=got.company, kinds=got.kind, **more).first()
    print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=1))


if __name__ == "__main__":
    main()
