"""The vocabulary that labels, rules and rankings share. They equal those of the data they describe."""

SENTIMENTS = ["positive", "negative", "neutral"]
TRAVELER_CONTEXTS = ["solo", "couple", "friends", "family_with_kids", "parents"]
CATEGORIES = ["hotel", "restaurant", "attraction"]

# category -> aspect -> allowed attributes
ATTRIBUTES = {
    "hotel": {
        "cleanliness": ["clean", "average", "dirty"], "noise_level": ["quiet", "moderate", "noisy"], "bed_comfort": ["comfortable", "average", "uncomfortable"], "room_size": ["spacious", "average", "cramped"],
        "bathroom_quality": ["good", "average", "poor"], "view_quality": ["good", "average", "poor"], "breakfast_quality": ["good", "average", "poor"], "room_condition": ["well_kept", "average", "worn"],
        "staff_service": ["friendly", "average", "unfriendly"], "amenities": ["available", "unavailable"], "parking_availability": ["available", "limited", "unavailable"], "parking_experience": ["easy", "average", "difficult"],
    },
    "restaurant": {
        "food_quality": ["good", "average", "poor"], "atmosphere": ["good", "average", "poor"], "freshness": ["fresh", "average", "not_fresh"], "portion": ["large", "normal", "small"], "waiting_time": ["none", "short", "long"],
        "serving_speed": ["fast", "average", "slow"], "seating_comfort": ["comfortable", "average", "uncomfortable"], "family_friendly": ["suitable", "unsuitable"], "staff_service": ["friendly", "average", "unfriendly"],
        "cleanliness": ["clean", "average", "dirty"], "noise_level": ["quiet", "moderate", "noisy"], "parking_availability": ["available", "limited", "unavailable"], "parking_experience": ["easy", "average", "difficult"],
    },
    "attraction": {
        "scenery": ["sea", "mountain", "city", "river", "night_view"], "photo_spots": ["good", "average", "poor"], "walking_burden": ["low", "medium", "high"], "slope_stairs": ["low", "medium", "high"],
        "activity_variety": ["many", "average", "few"], "stay_duration": ["short", "medium", "long"], "rest_facilities": ["sufficient", "lacking"], "toilet_facilities": ["sufficient", "lacking"],
        "weather_sensitivity": ["high", "low"], "parking_availability": ["available", "limited", "unavailable"], "parking_experience": ["easy", "average", "difficult"],
    },
}

# Keyword -> (what a wish says for it, weights of aspects). The first five are companions.
KEYWORDS = {
    "부모님": (r"부모님|어르신|어머니|아버지|엄마|아빠|효도", {"walking_burden": 2, "slope_stairs": 2, "rest_facilities": 2, "toilet_facilities": 1}),
    "아이": (r"아이|아기|애들|유모차|어린이|키즈|자녀", {"family_friendly": 3, "walking_burden": 1.5, "slope_stairs": 1.5, "toilet_facilities": 1.5}),
    "연인": (r"연인|커플|데이트|기념일|여자\s?친구|남자\s?친구|신혼", {"atmosphere": 2, "scenery": 1.5, "photo_spots": 1.5, "view_quality": 1.5}),
    "친구": (r"친구들?(?:이랑|과|와|끼리)", {"activity_variety": 1.5, "food_quality": 1}),
    "혼자": (r"혼자|혼행|혼밥", {"seating_comfort": 1, "noise_level": 1}),
    "걷기 부담": (r"걷기\s?(?:힘들|싫|어렵)|많이\s?(?:못\s?)?걷|다리가?\s?아프|무릎|계단|언덕|오르막|경사", {"walking_burden": 4, "slope_stairs": 4}),
    "경치·전망": (r"바다|오션|해변|경치|풍경|야경|전망|뷰", {"scenery": 3, "view_quality": 3}),
    "맛": (r"맛집|맛있|음식|먹거리", {"food_quality": 3, "freshness": 1}),
    "신선도": (r"신선|싱싱|회\b|해산물", {"freshness": 3}),
    "사진": (r"사진|인생샷|포토", {"photo_spots": 3}),
    "조용함": (r"조용|한적|소음|시끄", {"noise_level": 3.5}),
    "휴식": (r"휴식|쉬고|쉴|편하게|여유", {"rest_facilities": 2, "bed_comfort": 2, "seating_comfort": 1.5}),
    "청결": (r"깨끗|청결|위생", {"cleanliness": 3, "bathroom_quality": 1}),
    "친절": (r"친절|서비스", {"staff_service": 2.5}),
    "공간": (r"넓은|넓었|방\s?크기|좁", {"room_size": 2.5, "seating_comfort": 1}),
    "조식": (r"조식|아침\s?식사", {"breakfast_quality": 3}),
    "양": (r"양이?\s?많|푸짐|배부르", {"portion": 2.5}),
    "분위기": (r"분위기|감성|인테리어", {"atmosphere": 2.5}),
    "즐길 거리": (r"볼거리|즐길\s?거리|체험|할\s?거리|놀거리", {"activity_variety": 3}),
    "화장실": (r"화장실", {"toilet_facilities": 2.5}),
    "침구": (r"침대|침구|잠자리", {"bed_comfort": 3}),
    "웨이팅": (r"웨이팅|기다리|대기|줄\s?서|오래\s?걸", {"waiting_time": 4, "serving_speed": 1.5}),
    "주차": (r"주차|차\s?가지고|자차|운전", {"parking_availability": 3, "parking_experience": 3}),
    "혼잡": (r"사람\s?많|붐비|혼잡|북적", {"waiting_time": 1, "noise_level": 1.5}),
    "날씨": (r"날씨|비\s?오|우천|더위|추위", {"weather_sensitivity": 2.5}),
}
COMPANION_KEYWORDS = ["부모님", "아이", "연인", "친구", "혼자"]

# Condition of a search -> keyword whose weights it has; two conditions of one keyword count it once
CONDITION_KEYWORDS = {
    "with": {"parents": "부모님", "kids": "아이", "couple": "연인", "friends": "친구", "solo": "혼자"},
    "walk": {"low": "걷기 부담"},
    "pri": {"sea": "경치·전망", "food": "맛", "photo": "사진", "rest": "휴식", "quiet": "조용함"},
    "avoid": {"waiting": "웨이팅", "stairs": "걷기 부담", "noise": "조용함", "parking": "주차", "crowd": "혼잡"},
}

# district id -> name, in the order of listing
DISTRICT_NAMES = {
    "jung": "중구", "seo": "서구", "dong": "동구", "yeongdo": "영도구", "busanjin": "부산진구", "dongnae": "동래구", "nam": "남구", "buk": "북구",
    "haeundae": "해운대구", "saha": "사하구", "geumjeong": "금정구", "gangseo": "강서구", "yeonje": "연제구", "suyeong": "수영구", "sasang": "사상구", "gijang": "기장군",
}
# part of a place's text -> district id; the first that occurs counts
NEIGHBORHOODS = {
    "광안": "suyeong", "민락": "suyeong", "수영": "suyeong", "해운대": "haeundae", "센텀": "haeundae", "송정": "haeundae", "달맞이": "haeundae", "청사포": "haeundae", "해리단길": "haeundae",
    "기장": "gijang", "오시리아": "gijang", "일광": "gijang", "정관": "gijang", "서면": "busanjin", "전포": "busanjin", "부산진": "busanjin", "남포": "jung", "광복": "jung", "자갈치": "jung", "중앙동": "jung",
    "영도": "yeongdo", "태종대": "yeongdo", "송도": "seo", "암남": "seo", "다대포": "saha", "감천": "saha", "동래": "dongnae", "온천장": "dongnae", "부산역": "dong", "초량": "dong",
    "용호": "nam", "이기대": "nam", "대연": "nam", "경성대": "nam", "연산": "yeonje", "사상": "sasang", "금정": "geumjeong", "범어사": "geumjeong", "강서": "gangseo", "화명": "buk",
}
# Words and codes of sources for a category
CATEGORY_WORDS = {
    "hotel": ["hotel", "hotels", "숙박", "숙소", "호텔", "32", "accommodation", "lodging"],
    "restaurant": ["restaurant", "restaurants", "음식점", "식당", "맛집", "39", "food"],
    "attraction": ["attraction", "attractions", "관광지", "명소", "12", "14", "28"],
}
CATEGORY_BY_PREFIX = [("맛집", "restaurant"), ("카페", "restaurant"), ("관광", "attraction"), ("체험", "attraction"), ("숙소", "hotel")]

# words without which an aspect's evidence is off its topic; other aspects have no such rule
TOPIC_WORDS = {
    "parking_availability": "주차|차를|차량|차 |자가용|발렛",
    "parking_experience": "주차|차를|차량|차 |자가용|발렛",
    "photo_spots": "사진|포토|인생|촬영|카메라|찍",
    "freshness": "신선|싱싱|재료|비린|상한|냉동",
    "waiting_time": "웨이팅|대기|기다|줄|오래 걸|바로 입장|바로 앉|자리",
    "noise_level": "조용|시끄|소음|북적|한적|고요|떠들|시끌|음악|소리",
    "toilet_facilities": "화장실",
    "breakfast_quality": "조식|아침|뷔페",
    "weather_sensitivity": "날씨|비 |비가|햇|더위|더운|추위|추운|바람|실내|야외|그늘|우산|덥|춥",
    "slope_stairs": "계단|언덕|경사|오르막|가파|비탈|오르|내리막",
    "family_friendly": "가족|아이|애기|어린이|아기|유모차|키즈|부모|아들|딸",
    "bathroom_quality": "욕실|샤워|화장실|수압|욕조|세면|비데|온수|배수|물",
}
LEADING_FILLERS = ["전반적으로는", "전반적으로", "전체적으로는", "전체적으로", "솔직히", "그래도"]
CLEAN_WORDS = "깨끗|깔끔|청결|쾌적|말끔|정갈|위생|더럽|더러|지저분|불결|얼룩|곰팡이|먼지"
DIRTY_WORDS = r"더럽|더러|지저분|불결|얼룩|곰팡이|먼지|(깨끗|깔끔|청결)\S{0,4}\s?(않|못|아쉬)"
CONDITION_WORDS = "낡|오래된|오래돼|노후|허름|낙후|리모델링|수리|고장|세련|모던|고급스"
ROOM_TO_CLEAN = {"well_kept": "clean", "average": "average", "worn": "dirty"}

# cues by which reviews are sampled
NOT_POSITIVE = "아쉽|아쉬|(?<!종류)별로|불친절|비싸|실망|최악|불편|더럽|지저분|시끄|좁아|좁고|좁은|오래 기다|기다려야|느려|느리|늦게|짜요|짰|싱거|싱겁|비추|그닥|그저 그|보통|무난|그럭저럭"
ASPECT_CUES = {
    "food": "맛있|맛나|맛이|존맛|맛없", "atmosphere": "분위기|인테리어|감성", "staff": "친절|사장님|직원", "portion": "양이|양도|푸짐", "waiting": "웨이팅|대기|줄[이을]",
    "parking": "주차", "clean": "깨끗|청결", "noise": "조용|시끄", "seat": "좌석|자리|넓[어고은]", "scenery": "바다|야경|노을|전망|뷰", "photo": "사진|포토",
    "walking": "걷|산책|계단|언덕|오르막", "toilet": "화장실", "stay": "시간이|한참|금방", "traveler": "혼자|아이|아들|딸|애들|부모님|엄마|아빠|남편|와이프|남자친구|여자친구|친구[들와랑]|데이트",
}
COMMON_CUES = ["food", "atmosphere", "staff"]
BUCKETS = ["not_positive", "rich", "plain"]

# first four characters of a place's class code -> value
WEATHER_BY_CLASS = {
    "EX03": "high", "HS01": "high", "HS03": "high", "NA01": "high", "NA02": "high", "NA04": "high", "NA05": "high", "VE03": "high", "VE04": "high", "VE05": "high", "AC05": "high", "LS02": "high",
    "EX06": "low", "VE06": "low", "VE07": "low", "VE09": "low", "VE10": "low", "VE12": "low",
}
STAY_BY_CLASS = {"VE01": "short", "HS01": "short", "VE07": "medium", "EX06": "medium", "NA04": "long", "AC05": "long"}
