"""The stop words, the synonyms and the file extensions that results depend on."""

# Words left out before stemming.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can "
    "did do does doing don down during each few for from further had has have having he her here hers herself him himself his "
    "how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with you your "
    "yours yourself yourselves"
).split()

# Stemmed query term, then the stemmed terms it is widened by, in order.
SYNONYMS = {
    "ml": ["learn", "neural", "model"],
    "ai": ["intellig", "learn", "neural"],
    "learn": ["train", "model", "neural"],
    "neural": ["network", "deep", "learn"],
    "deep": ["neural", "learn", "layer"],
    "nlp": ["languag", "text", "process"],
    "llm": ["languag", "model", "transform"],
    "transform": ["attent", "neural", "model"],
    "classifi": ["label", "categor", "predict"],
    "clusters": ["group", "segment", "similar"],
    "embed": ["vector", "represent", "encod"],
    "vector": ["embed", "represent", "encod"],
    "infer": ["predict", "reason", "deduc"],
    "predict": ["infer", "forecast", "model"],
    "train": ["learn", "fit", "optim"],
    "optim": ["train", "tune", "minim"],
    "fine": ["tune", "adjust", "train"],
    "retriev": ["search", "fetch", "lookup"],
    "generat": ["creat", "synthes", "produc"],
    "token": ["word", "term", "lexem"],
    "distribut": ["cluster", "parallel", "scalabl"],
    "cluster": ["distribut", "node", "group"],
    "replicat": ["backup", "mirror", "copy"],
    "shard": ["partition", "split", "distribut"],
    "consensus": ["raft", "paxos", "agreement"],
    "raft": ["consensus", "leader", "elect"],
    "fault": ["error", "failur", "crash"],
    "failov": ["recov", "redundanc", "backup"],
    "latenc": ["delay", "rtt", "respons"],
    "throughput": ["bandwidth", "rate", "capac"],
    "scalabl": ["distribut", "elastic", "grow"],
    "microservic": ["servic", "api", "endpoint"],
    "messag": ["queue", "event", "stream"],
    "stream": ["flow", "event", "pipe"],
    "pipeline": ["workflow", "process", "stream"],
    "orchestr": ["schedul", "manag", "coordin"],
    "container": ["docker", "pod", "servic"],
    "kubernetes": ["k8s", "orchestr", "cluster"],
    "k8s": ["kubernet", "orchestr", "container"],
    "databas": ["store", "persist", "data"],
    "relat": ["sql", "table", "schema"],
    "sql": ["relat", "query", "databas"],
    "nosql": ["document", "key", "store"],
    "index": ["search", "lookup", "catalog"],
    "cach": ["memori", "store", "fast"],
    "persist": ["store", "disk", "durabl"],
    "transact": ["acid", "commit", "rollback"],
    "complet": ["consist", "durabil", "transact"],
    "replication": ["backup", "mirror", "distribut"],
    "wal": ["log", "write", "recov"],
    "lsm": ["tree", "storage", "compaction"],
    "sstable": ["immut", "disk", "storage"],
    "memtabl": ["buffer", "memory", "write"],
    "bloom": ["filter", "probablist", "lookup"],
    "compaction": ["merg", "clean", "lsm"],
    "search": ["retriev", "query", "find", "lookup"],
    "query": ["search", "request", "ask"],
    "rank": ["sort", "order", "score"],
    "relev": ["rank", "score", "match"],
    "semantic": ["meaning", "context", "embed"],
    "lexical": ["keyword", "token", "term"],
    "fuzzi": ["approxim", "edit", "typo"],
    "similar": ["close", "near", "relat"],
    "document": ["file", "text", "record"],
    "cloud": ["aws", "gcp", "azure", "infra"],
    "deploy": ["ship", "releas", "launch"],
    "monitor": ["observ", "metric", "alert"],
    "observ": ["monitor", "trace", "metric"],
    "metric": ["monitor", "kpi", "measur"],
    "log": ["event", "record", "trace"],
    "trace": ["span", "debug", "log"],
    "alert": ["notif", "warn", "alarm"],
    "ci": ["build", "test", "automat"],
    "cd": ["deploy", "releas", "deliver"],
    "network": ["connect", "protocol", "packet"],
    "protocol": ["tcp", "http", "grpc"],
    "grpc": ["rpc", "protobuf", "api"],
    "http": ["rest", "api", "web"],
    "api": ["endpoint", "interfac", "servic"],
    "request": ["call", "query", "invoc"],
    "respons": ["reply", "result", "output"],
    "error": ["except", "fault", "fail"],
    "except": ["error", "panic", "fault"],
    "concurr": ["parallel", "thread", "async"],
    "async": ["concurr", "nonblock", "goroutin"],
    "goroutin": ["thread", "concurr", "async"],
    "channel": ["pipe", "stream", "messag"],
    "interfac": ["contract", "api", "abstract"],
    "struct": ["object", "type", "record"],
    "function": ["method", "proc", "routin"],
    "algorithm": ["method", "approach", "logic"],
    "complex": ["big", "notati", "perform"],
    "perform": ["speed", "fast", "optim"],
    "memory": ["heap", "alloc", "ram"],
    "cpu": ["processor", "compute", "core"],
}

# Extensions read as they are, and those with a reader of their own.
RAW_EXTENSIONS = ".txt .md .log .csv .json .yaml .yml .py .ts .js .jsx .tsx .rs .java .c .cpp .h".split()
