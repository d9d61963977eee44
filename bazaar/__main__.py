"""Command line: list the analyses, run one and write its result, write all
panels, or write the base tables in the layout of ``bazaar.sources.layout``.

    python -m bazaar list
    python -m bazaar run rfm_buckets --base-dir /root/testdata/sf0.1 --out /shared/rfm
    python -m bazaar run rfm_buckets --schema commerce --base-dir /data/shop --out /shared/rfm
    python -m bazaar panels --base-dir /root/testdata/sf0.1 --out /shared/panels
    python -m bazaar layout --base-dir /root/testdata/sf0.1 --out /shared/layout --buckets 64
"""

from __future__ import annotations

import argparse

from bazaar.plans import catalog
from bazaar.plans.panels import _tables, write_panels


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="python -m bazaar", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    p = sub.add_parser("layout")
    p.add_argument("--base-dir", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--buckets", type=int, required=True)
    p.add_argument("--master", default=None)
    for name in ("run", "panels"):
        p = sub.add_parser(name)
        if name == "run":
            p.add_argument("analysis", choices=sorted(catalog.ANALYSES))
        p.add_argument("--base-dir", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--schema", choices=["test", "commerce", "layout"], default="test")
        p.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    if a.cmd == "list":
        for name, fn in catalog.ANALYSES.items():
            doc = (fn.__doc__ or "").strip().split("\n")[0]
            print(f"{name:36s} {doc}")
        return
    from bazaar.session import get_session
    from bazaar.sources.layout import write_layout
    from bazaar.sources.sinks import write_dataset

    spark = get_session(a.master)
    if a.cmd == "layout":
        print(write_layout(spark, a.base_dir, a.out, a.buckets))
    elif a.cmd == "panels":
        for name, path in write_panels(spark, a.base_dir, a.out, a.schema).items():
            print(name, path)
    else:
        tables, params = _tables(spark, a.base_dir, a.schema)
        print(write_dataset(catalog.ANALYSES[a.analysis](tables, params), a.out))
    spark.stop()


if __name__ == "__main__":
    main()
