"""Words of texts without spaces: hand-cut sentences, all paths, a dictionary learnt from a corpus, the table function and the stream job."""

import itertools
import math
import random

from pyspark.sql import functions as F

from tidemill.functions import keywords, segment
from tidemill.functions.segment import Segmenter
from tidemill.operators import stats
from tidemill.schemas import LOG
from tidemill.streaming import runners

GIVEN = {
    "研究": 80, "研究生": 30, "生命": 60, "命": 20, "的": 900, "起源": 25, "我": 500, "来到": 60, "北京": 120, "清华": 20, "清华大学": 30, "大学": 150, "大学生": 60, "前来": 20, "应聘": 15, "手机": 200, "手机壳": 40, "壳": 10, "华为": 50,
    "红色": 40, "连衣裙": 30, "连衣": 2, "裙": 10, "长裙": 12, "深空": 5, "灰色": 30, "深空灰": 6, "色": 20, "双卡": 12, "双待": 12, "移动": 40, "联通": 30, "电信": 30, "他": 300, "了": 600, "在": 500, "中国": 200, "人民": 120, "银行": 90, "中": 150,
}
CUT = [
    ("研究生命的起源", "研究 生命 的 起源"), ("我来到北京清华大学", "我 来到 北京 清华大学"), ("大学生前来应聘", "大学生 前来 应聘"), ("华为Mate40手机壳", "华为 mate40 手机壳"), ("红色连衣裙,长裙", "红色 连衣裙 长裙"),
    ("移动联通电信4G手机 双卡双待", "移动 联通 电信 4g 手机 双卡 双待"), ("他在中国人民银行", "他 在 中国 人民 银行"), ("王小明来到北京", "王小明 来到 北京"), ("", ""), ("Phone 12, ÉTÉ!", "phone 12 été"), ("我", "我"), ("鑫", "鑫"),
]


def test_hand_cut_sentences():
    cut = Segmenter(GIVEN)
    for text, want in CUT:
        assert cut(text) == want.split(), text
    assert cut(None) == [] and "".join(cut("龘龘大学" * 20_000)) == "龘龘大学" * 20_000


def test_the_best_of_all_paths():
    rng = random.Random(2)
    words = {"".join(rng.choices("甲乙丙丁", k=rng.randint(1, 3))): rng.randint(1, 50) for _ in range(25)}
    cut = Segmenter(words)
    for _ in range(200):
        run = "".join(rng.choices("甲乙丙丁戊", k=rng.randint(1, 7)))
        weight = lambda parts: sum(cut.weights[p] if p in cut.weights else cut._unknown(p) if len(p) == 1 else -math.inf for p in parts)
        ways = []
        for cuts in itertools.product((False, True), repeat=len(run) - 1):
            parts, at = [], 0
            for k, c in enumerate(cuts):
                if c:
                    parts.append(run[at : k + 1])
                    at = k + 1
            ways.append(weight([*parts, run[at:]]))
        # unknown characters are put together afterwards: taken apart again, the path weighs as much as the best
        got = [p for w in cut.cut(run) for p in ([w] if w in cut.weights else list(w))]
        assert math.isclose(weight(got), max(ways)), (run, got)


def corpus(n, seed):
    rng = random.Random(seed)
    letters = [chr(0x4E00 + k) for k in range(400)]
    words = list({"".join(rng.sample(letters, rng.choice((2, 2, 2, 3, 4)))) for _ in range(120)})
    single = rng.sample(letters, 20)
    return words, [[rng.choice(words) if rng.random() < 0.8 else rng.choice(single) for _ in range(rng.randint(3, 12))] for _ in range(n)]


def test_a_dictionary_learnt_from_a_corpus(spark):
    words, some = corpus(2500, 7)
    texts = spark.createDataFrame([("".join(s),) for s in some] + [(None,), ("",), ("no script",)], "t string").repartition(3)
    learnt = segment.learn(texts, "t")
    assert len(set(learnt) & set(words)) >= 0.95 * len(words)
    assert len(set(learnt) - set(words)) <= 0.2 * len(learnt)
    cut, right, all_ = Segmenter(learnt), 0, 0
    for s in some[:400]:
        spans = lambda parts: set(itertools.pairwise(itertools.accumulate([0, *map(len, parts)])))
        want, got = spans(s), spans(cut("".join(s)))
        right += len(want & got)
        all_ += len(want | got)
    assert right >= 0.8 * all_


def test_counts_equal_plain_ones(spark):
    texts = ["甲乙丙甲乙", "丙甲乙x甲乙丁", "甲乙"]
    got = {r.word: r for r in segment.candidates(spark.createDataFrame([(t,) for t in texts], "t string"), "t", least=1).collect()}
    assert got["甲乙"].n == 5 and got["丙甲乙"].n == 2
    assert math.isclose(got["甲乙"].cohesion, math.log(5 * 13 / (5 * 5)))
    # before: a run's start three times (each counts as new), 丙 twice; behind: 丙, 丁, the end three times
    left = -(2 / 5) * math.log(2 / 5) - 3 * (1 / 5) * math.log(1 / 5)
    assert math.isclose(got["甲乙"].entropy, left)


def test_table_function_and_stream_job(spark, tmp_path):
    cut = Segmenter(GIVEN)
    keywords.register(spark, cut, "cut_words")
    spark.createDataFrame([(t,) for t, _ in CUT] + [(None,)], "t string").createOrReplaceTempView("sentences")
    got = [r.word for r in spark.sql("select t, word from sentences, lateral cut_words(t)").collect()]
    assert sorted(got) == sorted(w for _, c in CUT for w in c.split())
    rows = [((f"m{k}", None, None, None, "0"), ("good_list", "x", t, 1), None, None, 1_700_000_000_000 + 1000 * k) for k, (t, _) in enumerate(CUT)] + [(("z", None, None, None, "0"), ("good_list", "x", "end", 1), None, None, 1_800_000_000_000)]
    pages = spark.createDataFrame(rows, LOG)
    pages.coalesce(1).write.json(str(tmp_path / "in"))
    runners.keyword_layer(spark.readStream.schema(LOG).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), tokenize=cut).awaitTermination()
    want = stats.keyword_stats(stats.searched(pages).withColumn("time", F.timestamp_millis("ts")), "fullword", "time", tokenize=cut).where("keyword <> 'end'")
    key = lambda d: sorted((r.stt, r.keyword, r.ct) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want) and ("清华大学" in {k for _, k, _ in key(want)})
