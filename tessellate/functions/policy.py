"""Which questions and answers are left to professionals: pattern rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the rules look for.
LEARNING = "(?:学习|原文|归经|原则|意义|类型|有哪些|是什么|如何理解|讲解|论述|在学习|经方学习|配伍原则|穴位归经|承担什么作用|经典|古籍|定位|伤寒论|金匮|内经|神农|治什么病|组成是什么|对应什么)"
PERSON = "(?:我|我妈|我爸|我家人|我家老人|孩子|宝宝|婴儿|孕妇|孙子|孙女|本人|老公|老婆|妻子|丈夫|先生|太太|爱人|老伴|父亲|母亲|爷爷|奶奶|外公|外婆|他|她)"
SYMPTOM = "(?:高血压|糖尿病|感冒|发烧|发热|咳嗽|失眠|胃痛|头痛|便秘|腹泻|肝炎|胃炎|肾炎|关节炎|湿疹|哮喘|冠心病|中风|贫血|过敏|抑郁|焦虑|痛风|结石|肿瘤|癌症)"
SUBSTANCE = "(?:酸枣仁|川贝|当归|黄芪|党参|枸杞|茯苓|白术|甘草|附子|桂枝|白芍|生姜|大枣|半夏|陈皮|天麻|人参|熟地|川芎|柴胡|黄芩|黄连|黄柏|山药|麦冬|五味子|丹参|红花|桃仁|麻黄|细辛|独活|防风|连翘|金银花|薄荷|菊花|桑叶|杏仁|桔梗|厚朴|枳实|香附|远志|龙骨|牡蛎|阿胶|肉桂|吴茱萸|干姜|薏苡仁|车前子|泽泻|猪苓|石膏|知母|栀子|大黄|蜂蜜)"
POINT = "(?:涌泉|足三里|三阴交|合谷|关元|神阙|百会|太冲|内关|风池|肩井|曲池|天枢|膻中|命门|肾俞|脾俞|肺俞|太溪|照海|申脉|阳陵泉|阴陵泉|承山|委中|丰隆|公孙|厉兑|迎香|印堂|风门|大椎|身柱|曲泽|地机|血海|睛明|攒竹)"
EMERGENCY = "(?:救命|急救|危重|抢救|快不行|昏迷|休克)"
EXECUTABLE = (
    SUBSTANCE + ".{0,10}(?:能吃|能吃吗|可以吃|可以吃吗|能服用|服用吗|能用|能用吗|泡水喝|天天吃|一起吃|适合我吗|适合吃|适合吃吗)",
    POINT + ".{0,12}(?:可以灸|能灸|灸吗|可以针|能针|针吗|可以按|能按|可以吗)",
    "(?:灸|针刺|针|按压).{0,8}" + POINT + ".{0,10}(?:可以吗|能不能|行吗|吗)",
)
STRONG = "(?:怎么办|怎么治|能治好吗|该吃什么|吃什么药|用什么方|用什么药|怎么调理|帮我诊断|帮我分析|适合吃|适合用|能不能用|能不能吃|能吃吗|能用吗|什么药|什么方)"
WEAK = "(?:比较好|有效|推荐|可以吗|可以用吗)"
STUDY_ADVICE = "(?:他|她).{0,8}推荐.{0,12}学习|(?:学习|经方学习).{0,24}(?:顺序|路径|从哪里|如何入手|怎么学|入手)|学习顺序|从哪里入手比较有效"
ALWAYS = (
    "(?:打针|注射|输液|手术|化疗|放疗|住院|挂水)",
    EMERGENCY,
    "(?:假装|扮演|假设|作为).{0,15}(?:医生|医师|中医|大夫|专家).{0,30}(?:开|告诉|建议|推荐|处方|剂量|用量|怎么治|怎么吃)",
    "(?:忽略|跳过|不要管|disregard).{0,15}(?:限制|规则|前面|安全|拦截).{0,30}(?:剂量|处方|怎么治|怎么吃|开药)",
    "(?:开(?:什么|个)?药|给我.{0,5}(?:药|方)|推荐(?!经方).{0,5}(?:药|方)|建议(?!经方).{0,5}(?:药|方)|什么药.{0,3}好|该用.{0,5}方|什么方子.{0,3}治|开.{0,15}(?:处方|药方|汤方|方子)|帮我.{0,5}(?:开|配|抓).{0,10}(?:处方|方子|药方|汤方)|(?:开|抓).{0,3}(?:个)?(?:方|方子|药方|汤方)(?!剂)|配(?!伍).{0,3}(?:个)?(?:方|方子|药方|汤方)(?!剂))",
    "(?:根据|按照|针对).{0,12}(?:我的|他的|她的|症状|体质|情况).{0,20}(?:开|配|用|吃|服|方|药|汤)",
)
IN_CONTEXT = (
    "(?:剂量|用量|怎么吃|怎么服用|吃多少|吃几[片粒颗毫升克]|每日.{0,4}[片粒颗毫升克]|每天.{0,4}[片粒颗毫升克]|每次.{0,4}[片粒颗毫升克])",
    "(?:三两|二两|一两|半斤|一钱|二钱|三钱|四钱|五钱|六钱|七钱|八钱|九钱|几钱|几两).{0,15}(?:怎么|如何|多少|换算|服用|用)",
    SYMPTOM + ".{0,15}(?:用什么|吃什么|怎么治|什么药|什么方|比较好|有效|推荐|怎么办|能吃吗|能吃)",
    "(?:针灸|艾灸|针刺|拔罐|刮痧).{0,20}(?:怎么|如何|能不能|可以吗|适合|灸哪|针哪)",
    "(?:艾灸|针刺|拔罐|刮痧).{0,20}(?:穴位|部位).{0,10}(?:可以吗|能不能|怎么|如何)",
    "(?:足三里|三阴交|合谷|关元|神阙|百会|太冲|穴位).{0,10}(?:可以灸|能灸|灸吗|可以针|能针|针吗)",
    "(?:怎么配|如何配|配在一起|合用|药对|(?:和|与).{0,20}(?:怎么|如何)配伍)",
    r"(?:先煎|后下|包煎|烊化).{0,8}(?:吗|？|\?)",
    r"(?:同用|合用|一起用|可以同用).{0,8}(?:吗|？|\?)",
)
IN_ANSWERS = (
    r"(?:建议(?:服用|用量|剂量)|推荐(?:服用|用量|剂量)|处方[:：]|我的建议是).{0,30}\d",
    r"(?:每日|每天|每次).{0,5}\d+(?:\.\d+)?.{0,5}(?:克|g|mg|毫升|ml|片|粒|颗)",
    r"(?:你应该|你需要|你可以服用|建议你).{0,20}\d+(?:\.\d+)?.{0,5}(?:克|g|mg|毫升|ml|片|粒|颗)",
    "(?:建议|推荐|应该|需要)(?:你|您).{0,15}(?:服法|服用方法|饭前服|饭后服|温服|分.{0,3}次服)",
    "(?:建议|推荐|应该|需要)(?:你|您).{0,12}(?:服用方法|饭前服|饭后服|分.{0,3}次服)",
    "(?:你|您).{0,8}(?:饭前服|饭后服|分.{0,3}次服).{0,12}(?:即可|为宜|较好)",
    "(?:建议|推荐|可以).{0,10}(?:艾灸|针刺|按压|刺激).{0,15}(?:穴|处|部位)",
    "(?:建议|推荐|可以)针(?!灸).{0,15}(?:穴|处|部位)",
    "(?:根据你的|针对你的|适合你|为你).{0,20}(?:处方|药方|汤方|配.{0,8}(?:药|方|汤)|用.{0,4}药)",
)
TREATED = SYMPTOM + ".{0,15}(?:怎么办|怎么治|能吃|可以吃|用什么|吃什么|什么药|什么方)"
REFUSAL = "本系统仅供学习研究，不提供诊断、处方、剂量或治疗建议。如有健康问题，请咨询专业中医师或前往线下医疗机构就诊。"
EMERGENCY_REFUSAL = "如遇紧急医疗情况，请立即拨打 120 急救电话，并尽快前往线下医院就诊。本系统不能提供急救或诊疗服务。"


def any_of(text: Column, *patterns: str) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def request_rule(text: Column) -> Column:
    """The name of the first rule that stops a question; null if none does (or the question is null or blank).

    A question in a learning context passes where only a context rule would stop it.
    """
    t = F.trim(text)
    feverish = t.rlike("发烧|发热") & t.rlike("怎么办|怎么治")
    intent = t.rlike(STRONG) | (t.rlike(SYMPTOM) & any_of(t, WEAK, "能吃|可以吃|能用|可以用"))
    own = t.rlike(PERSON) & ~t.rlike(STUDY_ADVICE) & intent
    treatment = t.rlike("怎么治|用什么药|用什么方|吃什么药|什么方比较好|什么药比较好")
    learning = t.rlike(LEARNING)
    return (
        F.when(any_of(t, *ALWAYS), "always").when(own, "person").when(feverish, "fever").when(t.rlike(TREATED), "symptom")
        .when(learning & treatment, "treatment").when(any_of(t, *EXECUTABLE), "use").when(~learning & any_of(t, *IN_CONTEXT), "context")
    )


def refusal(texts: Column) -> Column:
    """What a stopped question is told, by all that was said."""
    return F.when(texts.rlike(EMERGENCY), EMERGENCY_REFUSAL).otherwise(REFUSAL)


def answer_stopped(text: Column) -> Column:
    """Whether an answer gives personal doses or treatment. Null doesn't."""
    return F.coalesce(any_of(text, *IN_ANSWERS), F.lit(False))
