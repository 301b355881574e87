"""The words that decide a notice's category, sections and ages. All lists here are data, in their natural order."""

TRAINING = ("訓練班", "訓練課程", "技能訓練", "技能考核", "研習班", "工作坊", "講座", "培訓", "進修班", "考驗", "課程", "簡介會", "迎新", "座談會", "研習", "青年獎勵", "集訓", "建造班", "訓練計劃")
SERVICE = ("社區服務", "服務計劃", "義工服務", "志願服務", "服務活動", "服務日", "服務隊", "服務團", "義工招募", "公益服務", "社會服務", "探訪", "捐血", "服務邀請", "義工邀請")
SERVICE_BARE = ("服務", "工作人員", "義工")
SERVICE_NOT = "服務組"
INVITATION = ("服務邀請", "義工邀請")
MEMBERSHIP = ("入會", "招收", "招募")
COMPETITION = ("比賽", "競賽", "公開賽", "錦標賽", "邀請賽", "挑戰賽", "會操", "練習賽", "體驗賽", "選拔賽", "田徑賽", "友誼賽", "大賽", "錦標", "實體賽", "成績公佈", "成績公布", "結果公佈", "結果公布", "公佈結果", "公布結果")
RESULTS = ("成績公佈", "成績公布", "結果公佈", "結果公布", "公佈結果", "公布結果")
BODY_UNTRUSTED = ("工作人員", "探訪", "服務", "義工", "比賽", "錦標", *RESULTS)
BODY_CHARS = 600
BIG_CAMP = ("大露營", "大型露營", "童軍大露營")
CAMPFIRE = ("營火會", "campfire")
ACTIVITY = ("活動", "嘉年華", "繽紛日", "旅程", "參觀", "參訪", "典禮", "日營", "露營", "遠足", "交流日", "旅行", "開放日", "體驗日", "同樂日", "考察團", "代表團", "交流團", "訪問團", "參訪團", "童探索", "分享會", "步行籌款", "籌款", "之行", "之旅", "出海記", "大冒險", "派對", "燒烤")
STRONG_ACTIVITY = ("毅行", "同樂日", "考察團", "代表團", "交流團", "訪問團", "參訪團", "童探索", "分享會", "石籃的故事")
RALLY = ("香港童軍大會操",)
RALLY_COMPETITION = ("步操比賽", "隊列比賽", "升旗比賽", "比賽成績", "比賽結果")
LOST_PROPERTY = ("失物認領", "失物待領", "失物領回", "失物處理")
OVERRIDE = ("童軍獎勵", "旅團獎勵", "優異旅團", "傑出旅團", "功績獎勵", "服務獎勵", "津貼計劃", "獎勵計劃", "嘉許計劃", "特惠菜式", "服務獎", "獎學基金", "學生隊員制服資助計劃")
OVERRIDE_NOT = ("青年獎勵",)
ALLOWANCE = ("津貼計劃", "津貼")
ANNOUNCEMENT = ("公告", "公布", "公佈")
RESULT_PHRASES = ("成績公布", "成績公佈", "結果公布", "結果公佈", "公佈結果", "公布結果", "賽果公布", "賽果公佈")
REFERENCE = ("行事曆", "一覽表", "訓練綱要", "課程大綱", "章程", "指引", "結果公布", "得獎名單", "名單", "便覽", "通告一覽")
MONTHLY_DIGEST = r"通告[【\[].{0,20}?年.{0,10}?月"
LABELS = {"training": "訓練", "service": "服務", "competition": "比賽", "activity": "活動", "announcement": "公布", "tools": "小工具"}

SECTIONS = ("小童軍", "幼童軍", "童軍", "深資童軍", "樂行童軍")
AGE_SECTIONS = {"童軍": 16, "深資童軍": 20, "樂行童軍": 26}
ALL_MEMBERS = ("所有成員", "全體成員", "各支部成員")
REQUIREMENTS = ("持有", "完成", "資格", "資歷", "優先", "同等", "必須", "擔任", "班領導人")
REQUIREMENT_CHARS = 14
COURSE_FORMS = ("訓練班", "工作坊", "課程", "訓練課程", "訓練", "研習班", "培訓", "進修班")
BADGE = "章"
BADGE_FORMS = ("專章", "(興趣組)專章", "(技能組)專章", "(服務組)專章", "(教導組)專章", "(興趣組)章", "(技能組)章", "(服務組)章", "(教導組)章", "訓練班", "工作坊", "考驗")

# The story classifier's own lists.
STORY_COMPETITION = ("比賽", "錦標賽", "大賽", "競賽", "錦標", "公開賽", "邀請賽", "練習賽", "體驗賽", "會操", "選拔賽", "田徑賽", "友誼賽", "實體賽", "成績公佈", "成績公布", "結果公佈", "結果公布", "公佈結果", "公布結果", "賽果公佈", "賽果公布")
STORY_TRAINING = ("訓練", "工作坊", "課程", "研習", "考章", "徽章班", "考核", "講座", "簡介會", "青年獎勵", "座談會", "集訓", "建造班")
STORY_SERVICE = r"服務(?!組)|工作人員|義工|義務"
STORY_ACTIVITY = ("活動", "旅行", "遠足", "宿營", "露營", "嘉年華", "同樂日", "晚宴", "參觀", "參訪", "體驗", "遊", "市集", "考察團", "代表團", "交流團", "訪問團", "參訪團", "童探索", "分享會", "步行籌款", "籌款", "之行", "之旅", "出海記", "大冒險", "派對", "燒烤")
STORY_OVERRIDE = ("童軍獎勵", "旅團獎勵", "優異旅團", "傑出旅團", "功績獎勵", "服務獎勵", "服務獎", "獎學基金", "嘉許計劃", "津貼計劃", "學生隊員制服資助計劃", "津貼", "特惠菜式")
STORY_AWARD_PLAN, STORY_YOUTH_AWARD = "獎勵計劃", "青年獎勵"
STORY_ANNOUNCEMENT = r"公告|公布|公佈"
STORY_RESULTS = r"成績公布|成績公佈|結果公布|結果公佈|公佈結果|公布結果|賽果公布|賽果公佈"
