"""The fixed vocabulary: domains with their prompts and terms, and Vietnamese aliases of English terms."""

from __future__ import annotations

VERSION = 1

# Alias, without accents, and the term it stands for.
ALIASES = {
    "nguoi": "person",
    "con nguoi": "person",
    "dan ong": "man",
    "nam gioi": "man",
    "phu nu": "woman",
    "nu gioi": "woman",
    "tre em": "child",
    "em be": "baby",
    "dam dong": "crowd",
    "khuon mat": "face",
    "quan ao": "clothing",
    "kinh mat": "glasses",
    "xe hoi": "car",
    "o to": "car",
    "xe may": "motorcycle",
    "xe dap": "bicycle",
    "xe buyt": "bus",
    "tau hoa": "train",
    "may bay": "airplane",
    "tau thuyen": "boat",
    "duong pho": "street",
    "giao thong": "traffic",
    "den giao thong": "traffic light",
    "trong nha": "indoor",
    "ngoai troi": "outdoor",
    "phong khach": "living room",
    "phong ngu": "bedroom",
    "nha bep": "kitchen",
    "ban ghe": "furniture",
    "ti vi": "television",
    "do an": "food",
    "mon an": "food",
    "trai cay": "fruit",
    "nau an": "cooking",
    "the thao": "sport",
    "bong da": "football",
    "bong ro": "basketball",
    "boi loi": "swimming",
    "truong hoc": "school",
    "lop hoc": "classroom",
    "van phong": "office",
    "may tinh": "computer",
    "dien thoai": "phone",
    "sach vo": "book",
    "san khau": "stage",
    "bieu dien": "performance",
    "ca si": "singer",
    "nhac cu": "instrument",
    "tin tuc": "news",
    "van ban": "text",
    "tai lieu": "document",
    "bieu do": "chart",
    "dong vat": "animal",
    "con cho": "dog",
    "meo": "cat",
    "chim": "bird",
    "cay coi": "tree",
    "bai bien": "beach",
    "song nui": "landscape",
    "dong song": "river",
    "bau troi": "sky",
}

# Domain id, prompt and terms, in the order that breaks ties.
DOMAINS = (
    ("people", "people, faces, clothing and human social activity", (
        "person", "people", "man", "woman", "boy", "girl", "child", "baby", "face", "human", "clothing",
        "dress", "shirt", "crowd", "family", "glasses",
    )),
    ("transport", "vehicles, transportation, roads and traffic", (
        "vehicle", "car", "truck", "bus", "bicycle", "bike", "motorcycle", "train", "airplane", "boat",
        "ship", "road", "street", "traffic", "traffic light", "station",
    )),
    ("indoor_home", "indoor home rooms, household furniture and appliances", (
        "indoor", "home", "house", "room", "living room", "bedroom", "kitchen", "bathroom", "chair", "table",
        "bed", "sofa", "furniture", "television", "lamp", "window", "door",
    )),
    ("food", "food, meals, drinks, restaurants and cooking", (
        "food", "meal", "dish", "fruit", "vegetable", "meat", "bread", "rice", "drink", "bottle", "cup",
        "restaurant", "cooking", "kitchen", "cake",
    )),
    ("sports", "sports, exercise, games and athletes", (
        "sport", "athlete", "football", "soccer", "basketball", "volleyball", "tennis", "badminton",
        "swimming", "running", "ball", "sports uniform", "stadium", "exercise",
    )),
    ("work_school", "workplace, office, school, study and technology", (
        "work", "office", "school", "classroom", "student", "teacher", "book", "document", "computer",
        "laptop", "keyboard", "phone", "meeting", "presentation", "desk",
    )),
    ("event_stage", "public event, stage performance, music and entertainment", (
        "event", "stage", "performance", "concert", "music", "singer", "microphone", "instrument", "audience",
        "crowd", "dance", "festival", "ceremony",
    )),
    ("news_document", "news broadcast, text, documents, charts and information screens", (
        "news", "report", "broadcast", "text", "subtitle", "document", "chart", "graph", "map", "screen",
        "logo", "sign", "headline", "anchor",
    )),
    ("animals", "animals, pets, birds and wildlife", (
        "animal", "pet", "dog", "cat", "bird", "horse", "cow", "fish", "wildlife", "zoo",
    )),
    ("outdoor_nature", "outdoor nature, landscapes, weather and natural scenery", (
        "outdoor", "nature", "tree", "forest", "mountain", "landscape", "river", "lake", "sea", "beach",
        "sky", "cloud", "rain", "park", "field", "garden",
    )),
)
