"""Command line: python -m quern index ROOT FOLDER | search ROOT TEXT | delete ROOT ID... | status ROOT | log ROOT."""

from __future__ import annotations

import argparse

from .plans.pipeline import FileIndexer
from .plans.search import SearchIndex
from .session import local_session
from .sources.files import ActivityLog


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("what", choices=["index", "search", "delete", "status", "log"])
    p.add_argument("root", help="folder of the index")
    p.add_argument("rest", nargs="*", help="a folder, a query, ids or a filter")
    p.add_argument("-n", type=int, default=10, help="results or lines")
    p.add_argument("--lexical", action="store_true", help="without vectors")
    p.add_argument("--log", default="quern.log", help="activity log of this machine")
    a = p.parse_args(args)
    log = ActivityLog(a.log)
    if a.what == "log":
        print("\n".join(log.tail(a.n, " ".join(a.rest))))
        return
    index = SearchIndex(local_session(), a.root, lexical_only=a.lexical, fusion_top=a.n, exclusive=a.what in ("index", "delete"))
    try:
        if a.what == "index":
            done = FileIndexer(index, after=lambda r: log.append("INDEXED", f"{r['indexed']} files, {r['removed']} removed, {r['failed']} failed")).run(a.rest[0])
            print(done)
        elif a.what == "delete":
            index.delete(a.rest)
            log.append("DELETED", " ".join(a.rest))
        elif a.what == "status":
            s = index.tables()["stats"].first()
            print(f"{s.n} documents, {s.total_len} terms, version {index._manifest()['upto']}")
        else:
            for r in index.search(" ".join(a.rest), a.n).orderBy("rank").collect():
                print(f"{r['rank']:>3}  {r.score:.4f}  {r.id}")
            log.append("SEARCH", " ".join(a.rest))
    finally:
        index.close()


if __name__ == "__main__":
    main()
