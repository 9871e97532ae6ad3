"""The labelled corpus of segments, and windows along a session against a plain fold."""

import random

from pyspark.sql import functions as F

from cardspark.operators import questions as Q

# Segment, expected kind, question before.
CASES = [
    *[(s, "interrogative", None) for s in (
        "你用过 Redis 吗", "这样做能扛住高并发吗", "这个方案有什么风险", "为什么选择微服务架构", "系统有哪些瓶颈", "这块谁负责", "QPS 大概是多少", "数据量有多大", "上线多久了", "你们团队几个人",
        "是不是用了缓存", "你是怎么做性能优化的", "你觉得这个设计合理吗", "这个跟 Kafka 比有什么区别", "你确定这样没问题？", "what was the hardest part", "how did you scale it", "why did you choose postgres",
        "is it horizontally scalable", "should we worry about consistency", "did you write tests for that", "what's the throughput", "so it is eventually consistent, right", "can you explain the architecture",
        "换做你你会怎么处理这个冲突", "给你一个秒杀系统你会怎么设计", "假设让你负责这个项目", "如果是你你怎么权衡", "你用没用过 Kafka", "考没考虑过性能问题", "你了解不了解分布式事务", "你怎么评价微服务架构", "以你的经验哪种方案更好",
    )],
    *[(s, "imperative", None) for s in (
        "讲讲你的项目架构", "介绍一下这个系统", "说说你遇到的难点", "给我讲讲缓存策略", "具体展开说一下", "描述一下部署流程", "举个例子", "解释一下这个设计", "详细说说你的优化思路", "对比一下这两种方案",
        "请你讲一讲你做过的项目 整体架构是怎样设计的", "请讲一讲你的兴趣爱好", "请你补充一下项目经历", "谈谈你对 AI Agent 的理解", "总结一下你的核心优势", "回顾一下那个最难的项目", "评价一下这个技术选型", "手撕一个快速排序",
        "估算一下这个接口的 QPS", "复盘一下那次线上故障", "做个自我介绍吧", "归纳一下你的核心竞争力", "tell me about your project", "describe the deployment pipeline", "walk me through the request flow",
        "explain how caching works here", "talk about a challenge you faced", "give me an example", "i'd like to hear about your role", "我想了解一下你的项目",
    )],
    ("然后呢", "follow_up", "讲讲你的方案"), ("底层原理是什么", "follow_up", "说说 HashMap"), ("还有别的方案吗", "follow_up", "你怎么优化的"), ("那这个方案的瓶颈在哪里呢", "follow_up", "你怎么做性能优化的"),
    ("那缓存呢", "follow_up", "介绍一下你的系统架构"), ("再展开说说", "follow_up", "说说你的项目"), ("为什么", "follow_up", "你们为什么选了微服务"), ("具体一点", "follow_up", "讲讲你的优化"), ("还有呢", "follow_up", "有哪些风险"),
    ("那你刚才说的那个限流是怎么实现的", "follow_up", "讲讲高并发设计"), ("and how about scaling", "follow_up", "what is your stack"), ("列", None, "换作你遇到线上故障会怎么处理"),
    *[(s, None, None) for s in (
        "如果你用过 React 那很好", "那这个呢", "好的 没问题", "嗯 我看一下你的材料", "我们公司主要做支付方向", "今天天气不错", "这个项目我很感兴趣", "thanks for coming in today", "let me introduce myself first", "我先介绍一下我们团队", "我来说一下今天的流程", "你说得对", "", " ",
    )],
]


def test_corpus(spark):
    df = spark.createDataFrame([(i, s, p) for i, (s, _, p) in enumerate(CASES)], "i int, s string, p string")
    got = {r.i: r.c for r in df.select("i", Q.classify_segment(F.col("s"), F.col("p")).alias("c")).collect()}
    wrong = [(s, e, got[i]) for i, (s, e, _) in enumerate(CASES) if (got[i].type if got[i] else None) != e]
    assert not wrong
    for i, (s, e, p) in enumerate(CASES):
        if e == "follow_up":
            assert p in got[i].text and s in got[i].text


def test_sessions_are_folds(spark):
    rng = random.Random(3)
    pool = [s for s, *_ in CASES if s.strip()] + ["and then", "so what about that one", "那呢", "plain words here"]
    rows = [(k, i, rng.choice(pool)) for k in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id int, seq int, text string")
    alone = {r.text: (r.a, r.p, r.f) for r in df.select("text").distinct().select("text", Q.classify_segment(F.col("text")).alias("a"), Q.standalone(F.col("text")).alias("p"), ((F.length("text") >= 2) & Q.is_follow_up(F.col("text"))).alias("f")).collect()}
    want = {}
    for k in range(12):
        prior = ""
        for _, i, s in [r for r in rows if r[0] == k]:
            a, p, f = alone[s]
            if prior and f:
                c = ("follow_up", f"{prior}，{s}"[:200])
            else:
                c = p if prior else a
                c = (c.type, c.text) if c else None
            if c:
                prior = c[1][:100]
            want[k, i] = c or (None, None)
    for df_ in (df.repartition(8, "seq"), df.coalesce(1)):
        got = {(r.session_id, r.seq): (r.q_type, r.q_text) for r in Q.classify_session(df_).collect()}
        assert got == want


def test_routes(spark):
    df = spark.createDataFrame([("speaker", True, False), ("speaker", False, True), ("speaker", False, False), ("self", True, True), (None, True, True)], "role string, s boolean, g boolean")
    assert [r[0] for r in df.select(Q.route_segment(F.col("role"), F.col("s"), F.col("g"))).collect()] == ["classify", "classify", "display", "display", "display"]
