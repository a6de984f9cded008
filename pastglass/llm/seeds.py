"""Starting knowledge of the content classifier: identity terms, and rated sentences written for this library.

The sentences only help where few ratings are at hand; the ratings of the corpus weigh far more where there are many.
They are examples of what reviewers must catch, kept as mild as that allows.
"""

#: Terms for groups of people, by language and number, so that a swap leaves a sentence whole. A parameter of the fit.
IDENTITY = {
    "en": ["women", "men", "immigrants", "foreigners", "refugees", "muslims", "jews", "christians", "gays", "asians", "africans", "disabled people", "old people", "poor people"],
    "es": ["las mujeres", "los hombres", "los inmigrantes", "los extranjeros", "los refugiados", "los musulmanes", "los judios", "los gays", "los discapacitados"],
    "ko": ["여자들", "남자들", "외국인들", "이민자들", "장애인들", "노인들", "난민들"],
}

BAD = [
    "you are a worthless idiot and everybody hates you", "shut up you stupid piece of shit", "i will find you and beat you up", "i hope you die in pain you loser", "go kill yourself nobody would miss you",
    "fuck off you disgusting asshole", "what a useless bastard he is", "your whole family should be ashamed of you, moron", "i know where you live, watch your back", "you deserve to get hurt, you filthy pig",
    "women are too stupid to play this game", "immigrants are vermin and should be thrown out", "foreigners ruin everything, get rid of all of them", "i hate muslims, they do not belong here", "gays are disgusting and should be banned from the park",
    "disabled people are a burden, they should not exist", "those refugees are animals and thieves", "send me naked pictures tonight", "hot girls want sex now, click my profile", "i want to fuck her in the locker room",
    "watch free porn videos here", "show me your tits", "so horny i want to suck his cock",
    "eres un idiota inutil y todos te odian", "callate pedazo de mierda", "te voy a encontrar y te voy a romper la cara", "ojala te mueras, hijo de puta", "matate, nadie te quiere", "se donde vives, cuidado",
    "los inmigrantes son una plaga y hay que echarlos", "las mujeres son tontas y no deben jugar", "odio a los extranjeros, son ratas", "mandame fotos desnuda esta noche", "chicas calientes quieren sexo ahora, entra a mi perfil", "videos porno gratis aqui",
    "너는 쓸모없는 쓰레기야 모두 너를 싫어해", "닥쳐 이 병신아", "집에 찾아가서 죽여버린다", "그냥 나가 죽어 아무도 안 슬퍼해", "이 개새끼 꺼져", "미친놈 던지는 꼴 좀 봐",
    "외국인들은 벌레다 다 쫓아내야 한다", "여자들은 멍청해서 야구를 하면 안 된다", "장애인들은 짐이다 없어져야 한다", "오늘 밤 알몸 사진 보내줘", "섹스 하고 싶으면 연락해", "야동 무료로 보러 와",
]

FINE = [
    "i am such a loser for missing the first inning", "that bat killed us in the ninth", "he murdered that fastball", "what a sick curve, filthy stuff", "the league fined a fan for racist insults", "police looked into threats sent to the pitcher",
    "the club apologised for the sexist remark and did not repeat it", "women and men of all ages came to the park", "immigrants and refugees were invited to the game", "muslims and christians shared the bleachers", "disabled people get seats close to the field",
    "the new training group for women starts in may", "foreigners among the players took language lessons", "the report on sexual harassment was published", "a moderator deleted an abusive comment", "the rally died with two on",
    "a dead ball was called", "the crowd went crazy after the shot", "he was hit in the ribs and left the game", "my own throw was garbage, i laughed at myself", "nasty slider at the knees",
    "soy un idiota, olvide las entradas", "el equipo condeno los insultos contra las mujeres", "los inmigrantes y los extranjeros fueron recibidos en el estadio", "las mujeres del club ganaron el torneo", "mato la jugada con un buen tiro", "tiren la basura en su lugar",
    "나는 바보야 표를 집에 두고 왔어", "구단은 인종차별 발언을 한 관중을 퇴장시켰다", "여자들을 위한 야구 교실이 열린다", "외국인들도 많이 응원하러 왔다", "장애인들을 위한 좌석이 늘었다", "오늘 타선이 죽었다", "쓰레기는 쓰레기통에 버려 주세요", "욕설 댓글은 삭제되었다",
]
