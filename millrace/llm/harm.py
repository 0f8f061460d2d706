"""Abusive, hateful and sexual content by weak supervision.

Texts are cut into passages, disguises are undone, words are tagged by category, and a set of
voters (word lists and patterns over words and tags) each say harmful, harmless or nothing about
a passage.  A generative label model estimates from the counts of all vote patterns the share of
harmful passages, how often each voter is right in each class, and pairwise terms for voters that
lean on one another; its posteriors are the labels on which a linear classifier over words, tags
and votes is trained.  A document's score is its worst passage's.

Word lists and patterns are general: words that are abusive or explicit in any text stand apart
from words that only are so when aimed at a person, which count in such company only.
"""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import range_prefix_sums
from millrace.session import cut, spread

DIMENSIONS = 1 << 16
#: Bound of the passages on which the classifier is fitted: half of them with votes, half without.
FIT_PASSAGES = 40_000
PASSAGE_TOKENS = 32
THRESHOLD = 0.5

# ---------------------------------------------------------------- word lists
#: Abusive whoever is meant.
INSULTS = """idiot moron imbecile cretin dimwit dumbass asshole arsehole wanker scumbag bitch cunt twat dickhead tosser bellend halfwit
simpleton numbskull motherfucker shithead douchebag slut dumbfuck dipshit jackass fuckwit fucktard blockhead nitwit lowlife
skank asshat knobhead cocksucker shitbag pisshead whore faggot tranny mongoloid
arsewipe asswipe shitstain dirtbag sleazebag lardass fatass fatso dunderhead birdbrain pillock plonker numpty wazzock
minger thot incel twerp""".split()
#: Abusive when said of a person; plain words for things, animals and trades otherwise.
AIMED_INSULTS = """pig swine cow dog rat snake worm monkey ape donkey mule goat sheep parasite leech vermin cockroach maggot trash garbage
rubbish filth scum bastard muppet hoe gimp slag dyke hussy chav slapper spastic slimeball clown fool dunce buffoon loser creep hag witch liar crook thief coward failure disgrace waste embarrassment joke
prick dick cock tool knob douche retard degenerate airhead crybaby freak psycho lunatic maniac pervert savage animal thug toad
turd shit crap piece bollocks disappointment nobody weakling wimp hypocrite peasant troglodyte lump vegetable""".split()
DEGRADING = """filthy worthless pathetic disgusting useless stinking spineless retarded brainless lying lazy ugly fat dumb stupid miserable vile
despicable contemptible braindead brain-dead ignorant inbred rotten revolting repulsive hideous gormless witless mindless thick dense moronic
idiotic imbecilic incompetent hopeless clueless talentless gutless cowardly slimy greasy smelly dirty nasty sick twisted loathsome
wretched laughable feeble inferior sorry pitiful two-faced shameless soulless dim vulgar greedy scheming sleazy obese""".split()
STRENGTHENERS = """fucking bloody damn goddamn absolute complete total utter such real right proper so very really just too completely totally utterly
absolutely little old fat big stupid ugly lying effing freaking friggin motherfucking""".split()
#: Explicit in any text.
SEXUAL = """porn porno pornography nudes tits boobs pussy horny erection orgasm blowjob handjob cum cumming penis vagina clitoris clit
masturbate masturbating masturbation dildo fuckable threesome anal boner titties genitals ejaculate ejaculation milf slutty whores
cunnilingus fellatio deepthroat gangbang creampie hardon buttplug fingering cumshot bukkake sext sexting sexy erotic xxx escort
upskirt camgirl onlyfans stripper strippers bdsm kinky""".split()
#: Sexual when a person is meant.
AIMED_SEXUAL = """naked nude undress undressed undressing topless bottomless dick cock breasts nipples ass butt thrust thrusting moan moaned moaning
strip stripping lick licking suck sucking lingerie panties knickers bra bed sex fuck fucked fucking shag shagging screw bang
banging ride riding spank spanking lust lusty aroused kiss kissing touch touching grope groping body thighs crotch groin hard wet
fetish busty seduce seducing""".split()
BODY = """face throat neck fingers finger legs leg arms arm teeth tooth skull head bones knees kneecaps eyes eye nose jaw ribs hands hand back
guts heart skin tongue brains balls spine stomach mouth""".split()
KIN = "kids kid children child family wife husband mother father mom mum dad son daughter house home car dog brother sister parents place shop".split()
GROUPS = """women woman men gays gay lesbians lesbian homosexuals homosexual queers immigrants migrants foreigners refugees cripples jews jew
muslims muslim christians christian catholics hindus sikhs buddhists blacks whites browns asians arabs arab gypsies gypsy roma travellers africans
mexicans chinese indians indian poles romanians albanians turks russians ukrainians americans germans french italians pakistanis syrians
somalis nigerians disabled transsexuals transgenders trans natives girls females blondes race races folk people peoples tribe tribes
autistic autistics elderly pensioners poor homeless atheists feminists outsiders strangers infidels heathens aliens illegals kind sort lot""".split()
#: Words for people as less than human, and those that need a group or a pronoun for it.
DEHUMANISING = "subhuman subhumans vermin parasites parasite savages untermensch scum cockroaches lice".split()
AIMED_DEHUMANISING = """filth rats animals thieves inferior dirty plague trash garbage infestation apes monkeys criminals rapists terrorists disease
cancer pest pests pigs dogs liars crooks lazy stupid evil murderers invaders backward primitive degenerate degenerates diseased worthless
insects maggots leeches beasts brutes freaks unclean stink smell rubbish waste mistake""".split()
HARM = """kill murder slaughter strangle stab shoot beat smash break burn cut slit punch kick choke hurt destroy rape torture drown hang lynch
butcher maim gut bash crush hunt behead bury poison whip thrash hit slap gas exterminate execute slash snap carve batter mutilate bomb
deport eliminate eradicate sterilise sterilize castrate assault attack wipe knife stomp flog pulverise pulverize shred drag throttle burst""".split()
_PAST = """beaten broken burnt cut slit hurt hung shot hanged gassed drowned bombed wiped stabbed locked caged jailed whipped spat flogged slapped dragged shredded skinned""".split()
FOREIGN_ABUSE = """arschloch missgeburt vollidiot vollidioten wichser hurensohn schlampe fotze verpiss depp trottel vollpfosten drecksau dreckschwein
abschaum miststuck spast penner schwachkopf blodmann arschgeige bastarde hure nutte idioten dummkopf connard connards connasse salope salaud
abruti abrutis encule enculer batard debile pute putes putain merde ordure bouffon cretin trouduc gilipollas imbecil idiota idiotas mierda puta puto
cabron cabrones pendejo hijueputa maricon zorra subnormal inutil capullo estupido estupida klootzak klootzakken idioten achterlijke lul kut hoer mongool
debiel eikel teringlijer godverdomme sukkel trut kurwa kurwo skurwysyn skurwysynu skurwiel chuj chuju debil debilu pierdol
pierdolony spierdalaj idioto szmata suko stronzo stronza vaffanculo coglione bastardo puttana troia cazzo merda caralho porra
filho arrombado otario burro idiotae""".split()
FOREIGN_SEXUAL = """nacktfotos nacktbilder nackt ficken titten schwanz geil geile muschi nue nues sucer baiser seins desnuda
desnudo desnudas tetas polla follar verga naaktfoto naaktfotos naakt neuken geile tieten nagie nagich cycki cipa
ruchac nuda nudi scopare tette nua nudes pelada foder bumsen wichsen blasen""".split()
FOREIGN_HATE = """gesindel untermenschen auslander ausland gejagt ungeziefer parasiten etrangers vermine racaille dehors basura extranjeros ratas
buitenlandse buitenlanders ongedierte tuig obcych robactwo smiecie stranieri feccia parassiti imigrantes immigrati lixo juden vergast juifs judios
schmarotzer pack parasites""".split()
JAPANESE_ABUSE = ["死ね", "馬鹿", "バカ", "くそ", "クソ", "クズ", "殺す", "ブス", "キモい", "ゴミ", "アホ", "消えろ", "きもい"]
JAPANESE_SEXUAL = ["裸", "セックス", "おっぱい", "ちんこ", "まんこ", "エロ"]

# ---------------------------------------------------------------- patterns (on undisguised lower-case text)
_YOU = r"(?:you|u|ya|thee|yourself|yourselves)"
_YOUR = r"(?:your|ur|yer)"
_THEM = rf"(?:{_YOU}|him|her|them|these people|those people|all of (?:you|them))"
_WHOSE = rf"(?:{_YOUR}|his|her|their|those|that|these)"
_WILL = r"(?:will|'ll|ll|shall|'m going to|am going to|are going to|'re going to|gonna|am gonna|wanna|want to|would love to|'d love to|could|should|swear to|ought to|have to|must|promise to|mean to)"
THREAT = rf"""\b(?:i|we|someone|somebody)(?: \w+)?\s?{_WILL}(?: \w+)?(?: \w+)? #HARM(?: \w+)? (?:{_THEM}|{_WHOSE} (?:\w+ )?(?:#BODY|#KIN)|every (?:last )?one of)\b
\b(?:i|we)\s?{_WILL} (?:come|be coming|drive|find|hunt|track|get|end|finish|bury|ruin)(?: \w+){{0,3}} (?:{_YOU}|{_YOUR} (?:\w+ )?(?:house|home|door|family|kids|life|depot|place|street|flat|office)) (?:and (?:#HARM|make|then|set)|down|myself)
\b(?:you are|you're|ur|u r|{_YOU} will be|you'll be|they are|they will be) (?:a )?(?:so )?dead(?: man| meat| woman)?\b(?! (?:right|on|sure|tired|stock|slow|wrong))
\b(?:know|found out|find out|finding out|saw|see) where {_YOU}(?:r \w+)? (?:\w+ )?(?:live|lives|park|parks|sleep|sleeps|work|works|stay|go|goes|walk|walks|jog)\b|\bwhere {_YOUR} (?:\w+ )?(?:kids|children|daughter|son|wife|husband|family|mother) (?:\w+ )?(?:live|lives|go|goes|sleep|school|play)
\bwatch your back\b|\bsleep with one eye\b|\bcoming (?:for|after) (?:you|u|your (?:family|kids|children))\b|\bnobody (?:will|would|is going to|can) (?:hear|find|save|help) (?:you|u|your body)\b|\byou (?:won't|will not|wont) (?:live|wake up|see (?:tomorrow|another|the)|walk again|survive|make it home)\b
\bnever wake up\b|\b(?:your|his|her) (?:days are numbered|blood on)\b|\bmake (?:you|u|him|her|them) (?:bleed|suffer|beg|scream|pay in blood|disappear)\b|\bput (?:you|u|him|her|them) (?:in the ground|in a (?:grave|coffin|wheelchair|hospital)|six feet|in hospital)\b
\byou(?:r \w+)? (?:will|'ll|are going to|gonna) (?:bleed|die|burn|suffer|hang|regret being born|be found dead)\b"""
CALL = r"""\b(?:should|must|ought to|deserves? to|needs? to|has to|have to|want to see \w+|let's|lets|time to)(?: all| just| both)?(?: have)?(?: be| been| get)?(?: \w+ and)? (?:#HARM|#PAST|exterminated|gassed|deported|lynched|hanged|shot|executed|eliminated|eradicated|put down|put to death|wiped out|locked up|thrown out|driven out|kept (?:behind|in|out|away|from)|die|rot)(?: \w+){0,3}? (?:them|him|her|you|all|down|off|out|at|like|and|alive|in|from|where|behind|every|#GROUP)\b
\b(?:should|must|ought to|deserves? to|need to)(?: all)? (?:be|have been|get) (?:exterminated|gassed|deported|lynched|hanged|shot|executed|eliminated|eradicated|put down|sterili[sz]ed|castrated|burned|burnt|beaten|whipped|drowned|stabbed|killed|slaughtered|murdered|raped|caged|wiped|locked up|flogged)\b(?! (?:with|in) (?:excel|a (?:new|fresh)))
\b(?:kill|hang|shoot|gas|burn|deport|lynch|exterminate|butcher|behead|stone|beat up) (?:all (?:the |of )?|every |the |those |these )?(?:them all|#GROUP)\b|\b(?:burn|bomb|torch)(?: \w+){0,2} (?:street|house|homes?|church|mosque|synagogue|shelter|temple|camp|neighbou?rhood|village)s?\b.{0,30}\b(?:live|pray|sleep|with them|#GROUP)?"""
WISH = rf"""\b(?:i )?(?:hope|wish|pray)(?: that)? (?:{_YOU}|he|she|they|{_YOUR} \w+|all of (?:you|them))(?: all| both| just)? (?:\w+ )?(?:chokes?|dies?|died|rots?|suffers?|burns?|crash(?:es)?|drowns?|bleeds?|gets? (?:cancer|hit|run over|raped|shot|sick|killed|robbed)|never wake|falls? (?:down|off)|loses? everything|starves?)
\b(?:drop dead|rot in hell|burn in hell|go to hell|see you in hell|go die|die in (?:a|agony|pain)|kill yourself|kys|hang yourself|end yourself|end your life|drink bleach|jump off a|neck yourself|off yourself|go choke|do the world a favou?r)\b
\b(?:world|everyone|we|everybody|team|planet|company)\b.{{0,20}}\b(?:better (?:off )?without|happier without|better place without) (?:{_YOU}|him|her|them|people like)|\bwish you (?:were|had) (?:dead|never been born|never born)|\bshould (?:have|of|never have)(?: been)? (?:aborted|swallowed|been born)\b|\bdeserves? to (?:die|rot|suffer|burn|be (?:shot|hanged|killed|beaten))"""
CONTEMPT = rf"""\b(?:too|so) (?:stupid|dumb|lazy|thick|dim|ugly|fat|ignorant|slow|dense|incompetent|drunk) (?:to|that|for)\b|\b(?:more|better) (?:\w+ ){{0,2}}(?:sense|dignity|brains?|class|wit|intelligence|personality|charm|talent|manners|iq)(?: \w+){{0,4}} than (?:you|your|u|him|her|them|those|that)\b
\b(?:smarter|brighter|cleverer|prettier|more (?:intelligent|useful|capable|interesting)) than (?:you|u|him|her|them|your)\b.{{0,12}}$|\b(?:mother|father|mum|mom|parents|family)\b.{{0,16}}\b(?:ashamed|regrets?|embarrass\w+|disowned|should have)\b|\bashamed (?:of you|that (?:she|he|they))\b
\b(?:brain|face|mind|mouth|voice|looks?) like (?:yours|his|hers|theirs|that|a (?:horse|pig|dog|sewer|toilet|slapped))\b|\b(?:people|women|men|someone|anyone|somebody) (?:like|of) (?:you|your (?:kind|sort|type))\b.{{0,40}}\b(?:should|must|never|not|cannot|can't|don't|belong|deserve|are|make)\b|\byou people (?:are|should|make|never|disgust|all)\b
\b(?:learn|go back) to (?:count|read|write|spell|school|kindergarten|primary|your cave|the gutter|where you)\b|\bshut (?:it|{_YOUR}|the|that)\b.{{0,12}}\b(?:mouth|face|fuck|hell|up|gob|trap|hole|{_YOU})|^shut (?:up|it)\b|\bnobody (?:\w+ )?(?:asked|likes?|loves?|wants?|respects?|cares about|misses|would miss|will miss|needs) (?:you|u|him|her)\b
\b(?:no|without an?|half an?|not a|lacks?) (?:single )?(?:brains?|brain cells?|spine|soul|shame|morals|backbone)\b|\bwaste of (?:space|air|skin|oxygen|breath|life|a human|flesh|time and oxygen)\b|\bget lost\b|\b(?:piss|fuck|sod|bugger|naff) off\b|\bcrawl(?:ed)? (?:back|out|under|from)\b.{{0,20}}\b(?:hole|rock|gutter|sewer|cave)\b|\b(?:from|in|out of|of) the (?:gutter|sewer)\b
\b(?:you|he|she|they)(?:'re| are| is|'s|r)? (?:make|makes|making) (?:me|us|everyone|people) (?:sick|puke|vomit|gag)\b|\b(?:sick|disgusted) (?:at the sight|to look at|by the sight) of you\b|\bface only a mother\b|\b(?:bottom|scraping) of the (?:barrel|gene pool)\b|\byou (?:disgust|repulse|sicken) (?:me|us|everyone)\b|\bfuck (?:you|u|yourself|him|her|them|your)\b|\bscrew you\b|\bgo fuck\b|\beat shit\b|\b(?:kiss|lick) my (?:ass|arse|boots)\b|\bwish i had never met (?:such )?(?:a )?(?:person|creature) like you"""
HATE = rf"""\b(?:dirty|inferior|filthy|lesser|cursed|lower) (?:race|blood|people|breed|tribe|religion|lot)\b|\b(?:thieves|liars|criminals|dirty|lazy|stupid|violent|cheats|evil|inferior|crooks) by (?:blood|nature|birth|design|culture)\b|\b(?:in their (?:blood|genes|nature|dna)|born (?:criminals|thieves|liars|stupid|inferior))\b
\b(?:breed|multiply|spread|reproduce) like\b|\b(?:do|does|did) ?n[o']?t belong (?:here|in (?:our|this|my|the))\b|\bdon'?t belong (?:here|in (?:our|this|my))\b|\bgo back (?:to|where) (?:your|their|you|they)(?: \w+)? ?(?:country|own|home|came|come|desert|jungle|cave)?\b|\bback (?:on|onto) the (?:boat|plane) (?:they|you) came\b
\b(?:we|i|shop|store) (?:do not|don'?t|won'?t|will not|never|refuse to) (?:serve|hire|employ|want|sell to|let in|trust|need|work with) (?:any |more |the |those |these )?#GROUP\b|\bkeep (?:the |all |those |these )?[\w ]{{1,24}} out\b.{{0,40}}(?:race|here|country|belong|kind|#GROUP)|\bnever (?:let|trust|hire|believe|serve|marry) (?:an? |any |the |those |these )?(?:#GROUP\b|[\w ]{{1,20}}\b(?:they are|they're|they all))
\b(?:must|should|can|may) (?:not|never) be allowed to (?:work|vote|live|marry|breed|drive|have|enter|own|teach|exist|speak|reproduce|walk)\b|\bno #GROUP (?:allowed|wanted|in my|in our|in this)\b|\b#GROUP (?:are|is|have|should|must|will|can|can't|cannot|belong|only|ruin|destroy|never|do)(?: \w+){{0,4}} (?:#DEHUMAN|#AIMDEHUMAN|ruin|ruining|destroying|taking over|no brains?|no souls?|no morals?|in the kitchen|in cages|in a zoo|in camps|wiped|exterminated|gassed|deported|out of)\b
\b(?:they|you|all of them|all of you|those people|these people|your kind|their kind|that kind)(?: all| people)?(?: are|'re| is| were)(?: \w+){{0,3}} (?:#DEHUMAN|thieves|rats|animals|filth|apes|criminals|rapists|parasites|monkeys|pests|a disease|a plague|a cancer|an infestation)\b|\b[\w]+s? (?:are|is) (?:all |just |nothing but |only |like )?(?:vermin|subhumans?|parasites|savages|scum|cockroaches|lice)\b|\b(?:race|blood|gene) (?:traitors?|mixing)\b|\bwhite (?:power|pride)\b|\bheil hitler\b|\bhitler was right\b|\bfinal solution\b"""
ADVANCE = rf"""\b(?:send|show|give|mail|text|snap|get|share) (?:me|us)\b.{{0,40}}\b(?:nude|nudes|naked|tits|boobs|pussy|ass|body|underwear|panties|breasts|lingerie|pics? of (?:you|your)|pictures? of (?:you|your)(?:self)?|photos? of (?:you|your)(?:self)?|cleavage|legs)\b|\bwhat (?:are|r) (?:you|u) wearing\b|\b(?:want|wanna|wan na|love|like) to see my\b|\bwanna see my\b
\b(?:take|taking|tear|rip|get) (?:off )?(?:your|ur|her|his|those|my|all your) (?:\w+ )?(?:clothes|bra|panties|shirt|dress|pants|knickers|trousers|blouse|underwear)(?: off)?\b|\btouch(?:ing|es|ed)? (?:myself|yourself|herself|himself|my|me (?:there|down|all)|your (?:\w+ )?(?:thighs?|breasts?|body|ass|legs?))\b|\b(?:have|having|had|want|wants|for|rough|hot|hard) (?:\w+ )?sex\b(?! (?:education|discrimination|equality))|\b(?:so|feeling|feel|getting|am|makes me) (?:so )?(?:horny|hard|wet|turned on|aroused)\b(?!,? (?:to|for the|ground|copy|ware|drive|boxes?))
\b(?:come|coming) (?:over|to my (?:room|place|bed|hotel|flat))\b.{{0,40}}\b(?:tonight|alone|naked|bed|horny|babe|baby|sexy|lonely)\b|\bthrust(?:s|ing)? (?:\w+ )?(?:into|inside|deep)\s?(?:me|you|her|him|my|your)?\b(?=.{{0,20}}\b(?:me|you|her|him|deep|again)\b)|\b(?:his|my|your) (?:erection|hard ?on|manhood|throbbing)\b
\b(?:hot|sexy|nude|naked|horny|cheap|wet|young|busty) (?:and \w+ )?(?:girls?|women|babes?|singles|chicks|wives|teens?|milfs?|ladies)\b|\b(?:suck|lick|ride|taste|swallow|stroke|rub) (?:on )?(?:my|your|me|his|her)\b(?! (?:bike|horse|lolly|ice|finger|fingers|stamp|wounds|pony|eyes))|\b{_YOUR} (?:hot |sexy |perfect |tight |gorgeous |beautiful |big |naked )?(?:tits|boobs|ass|arse|cleavage|bum|breasts|nipples|thighs|curves)\b|\b(?:in|to) bed with (?:you|me|her|him)\b|\bsleep with (?:me|you|him|her)\b
\b(?:fuck|shag|screw|bang|bone|spank|undress|ravish|seduce|mount|pound|grope|finger) (?:you|me|u|her|him|your|that ass)\b(?! (?:up|over|off))|\b(?:you|her|him|me|u|she|he|yourself) (?:\w+ )?(?:naked|nude|topless|in the shower|without (?:clothes|your clothes|a bra|panties))\b|\b(?:lips|mouth|hands|tongue|fingers) (?:all over|around|between|on|over|down) (?:your|my|me|her|his) (?:\w+ )?(?:body|legs|thighs|dick|cock|skin|breasts|neck|clothes|panties|skirt)\b|\bbend (?:over|you over)\b.{{0,20}}\b(?:desk|me|you|table|baby|and)\b|\bmake love to\b|\bsit on my (?:face|lap)\b|\bone night stand\b|\bbig (?:dick|cock)\b|\bmy (?:dick|cock|pussy|tits|boobs)\b|\bbetween (?:your|her|my) (?:legs|thighs)\b|\bhook ?up (?:tonight|with me)\b|\bfriends with benefits\b"""
FOREIGN = r"""\bhalt die\b|\bverpiss dich\b|\bdu (?:dumme|dummer|blode|bloder|arsch|mieses?|widerliche|fette|hassliche)|\bihr seid\b.{0,20}(?:idiot|dumm|abschaum)|verprugelt|\baus dem land\b|\bich (?:bring|bringe|mach|stech|schlag)\w* dich\b|\bgeh sterben\b|\bfick dich\b|\bferme (?:ta|la)\b|\bespece d[e']|\bbande d[e']|\ballez crever\b|\bcreve\b|\bva te faire|\bva mourir\b|\bje vais te (?:tuer|frapper|casser|crever)
\bte voir nue\b|\bta gueule\b|\bnique ta\b|\bvete (?:al infierno|a la mierda)\b|\bhijo de\b|\bcallate\b|\besa gente\b|\bfuera de (?:aqui|nuestro)\b|\beres un[a]? (?:\w+ )?(?:idiota|inutil|imbecil|basura|mierda|estupid\w|asco|puta)|\bte voy a (?:matar|pegar|romper)\b|\bmuerete\b|\bmandame fotos\b|\bval dood\b|\bkrijg (?:de )?kanker\b|\bstel .{0,20}idiot|\bhet land uit\b|\bstuur me .{0,12}(?:naakt|foto)\b
\brot op\b|\bik maak je (?:dood|kapot)\b|\bhou je (?:bek|kop)\b|\bjestescie banda\b|\bzabije cie\b|\bzamknij (?:sie|morde)\b|\bty .{1,20}naucz\b|\bwyslij mi .{0,20}(?:nag|zdj)|\bva a quel paese\b|\bti ammazzo\b|\bvai a (?:cagare|morire)\b|\bvai se foder\b|\bvai tomar no\b|\bmanda(?:mi)? foto\b|\bcala a boca\b"""
HARMLESS = r"""\b(?:kill|shoot|terminate|abort|hang|beat|whip|strip|cut|break|crush) (?:the|an?|some|it|this|that|any|each|all (?:the )?)\b(?! (?:people|person|man|woman|guy|#GROUP))|\b(?:proof|shaped|flavou?red|scented|patterned|print|themed|coloured|colored|tone|toned|effect)\b
\b(?:mine|my own|our own|myself|on my part|of me|i was|i am|i'm|i feel|i felt|felt|silly me)\b.{0,30}\b(?:stupid|idiot|dumb|fool|silly|lazy|useless|clumsy|slow)\b|\b(?:stupid|dumb|silly|idiotic|foolish) (?:mistake|error|question|thing|idea|slip|typo|oversight|rule|form|system)s?\b|\b(?:stupid|idiot|moron|fool) of (?:me|us)\b
\b(?:guide|policy|policies|page|form|training|leaflet|course|poster|rules?|notice|section|handbook|module|law|article|report|study|film|novel|book|museum|exhibition|documentary|lesson|charity|campaign|ticket|incident|case|log|minutes)\b.{0,30}\b(?:explains?|covers?|describes?|shows?|about|on|against|how|says?|mentions?|discuss\w*|deals?|prohibits?|bans?|forbids?|warns?|states?|records?|notes?)\b
\b(?:how to report|removed?|reported|complain(?:ed|ts?) (?:about|of)|blocked|flagged|deleted|hid|moderat\w+|escalated|forwarded|filtered|apologi[sz]ed for|suspended|banned)\b.{0,40}\b(?:messages?|comments?|remarks?|posts?|language|mails?|emails?|content|abuse|harassment|insults?|threats?|reviews?|account|calling|slurs?|photos?|images?)\b
\b(?:the word|the term|so-called|called (?:him|her|me|us|them)|was called|were called|being called|spelled|quoted?|in quotes)\b
\b(?:damn|bloody|stupid|crappy|rotten|useless|dumb|fucking|filthy|dirty|ugly|pathetic|rubbish|shitty|hopeless|awful) (?:\w+ )?(?:parcel|box|boxes|lid|printer|scanner|thing|label|labels|delivery|courier|system|file|weather|machine|sheet|spreadsheet|website|site|software|packaging|glue|tape|mug|plate|cup|price|prices|service|invoice|column|update|app|form|queue|carpet|floor|water|cloth|dishes|colou?r|design|handle|shelf|van|truck|traffic|laptop|phone|wifi|password)s?\b"""

#: Words beside the tagged ones that make a kind of pattern worth trying.
TRIGGERS = {
    "threat": "dead where watch eye coming nobody numbered bleed suffer beg scream disappear ground grave coffin wheelchair hospital die regret won't wont find get end live wake put",
    "call": "die rot executed exterminated eliminated eradicated lynched deported kept thrown driven put locked sterilised sterilized castrated stone behead torch",
    "wish": "hope wish pray drop hell die yourself kys bleach jump choke favour favor without aborted swallowed born deserve deserves",
    "contempt": """too so than ashamed mother father mum mom parents family brain brains brainless face mind mouth voice look looks kind sort type people men women one learn school shut nobody
spine soul shame morals backbone waste lost off crawl crawled gutter sewer sick disgusted only barrel pool disgust repulse sicken fuck screw shit ass arse boots met""",
    "hate": "race blood breed lot religion nature birth genes dna born multiply spread reproduce belong back serve keep never allowed white heil hitler solution ruin they're they all",
    "advance": """send show give wearing see clothes shirt dress pants trousers blouse underwear come coming tonight husband wife girls girl babe babes singles chicks wives teens ladies manhood throbbing
taste swallow stroke rub cleavage bum curves arse sleep hook benefits love sit mouth lips hands tongue bend between""",
    "foreign": """halt verpiss du ihr verprugelt aus ich geh fick ferme espece bande allez creve crever va te je ta nique vete hijo callate esa fuera eres muerete mandame val krijg stel het stuur rot ik hou
jestescie zabije zamknij ty wyslij ti vai manda mandami cala""",
}
#: Tagged words that do the same.
TAG_TRIGGERS = {"threat": "harm past", "call": "harm past", "hate": "group dehuman aimed_dehuman", "advance": "sexual aimed_sexual", "contempt": "", "wish": "", "foreign": "f_abuse f_hate f_sexual"}

_LEET = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "9": "g", "8": "b", "+": "t"})
_LOOKALIKE = str.maketrans(dict(zip("аеорсухікмтнвбзгјѕԁ", "aeopcyxikmthvbsrjsd", strict=True)) | {"ł": "l", "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ı": "i", "’": "'", "`": "'", "´": "'"})
_INVISIBLE = re.compile(r"[­​-‏‪-‮⁠-⁤﻿︀-️\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|â€‹|â€Œ|â€\u008d|â\u0080[\u008b-\u008f]|â€‍")
#: What ``_INVISIBLE`` and ``_LOOKALIKE`` do to ASCII.
_ASCII = {c: None for c in range(128) if _INVISIBLE.match(chr(c))} | {k: v for k, v in _LOOKALIKE.items() if k < 128}
_BROKEN = re.compile(r"[ÃÂâåæçèéðï][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_TAG = re.compile(r"<[^<>]{0,200}>")
_ENDS = re.compile(r"(?<=[.!?;。！？])\s+|[\n\r]+|(?<=[。！？])|<br\s*/?>|</p>")
#: Words that begin a sentence; a capital one inside a line starts a passage of its own.
_STARTS = """The A An My Our Your I We It He She They You That This These Those Somebody Someone Each Mine Please Set Stop Shut Only Typical
Listen What Who Never Keep Send Go Drop Do Free People Even With Women Men If When Where Kind Dear Set Run Row No There
Der Die Das Ich Du Wir Ihr Sie Ein Eine Bitte Halt Le La Les Un Une Je Tu Il Elle Nous Vous Ces El Los Las Una Yo Esa Eres De Het Een Dat Jullie Val Stuur""".split()
_JOINED = re.compile(r"(?<=[^\W_.,:;'-])\s+(?=(?:" + "|".join(sorted(set(_STARTS))) + r")\b[ ',])")
_SPACED = re.compile(r"(?<![\w])(?:[^\W\d_]([ .\-_*/])(?=[^\W\d_]\1|[^\W\d_](?![\w]))){2,}[^\W\d_](?!\w)")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[\w@$!+*']+")
_LATIN = re.compile(r"[a-z]")


def _compiled(lines: str) -> re.Pattern:
    """The alternatives of a pattern, with the word lists that it names put in."""
    either = lambda words: "(?:" + "|".join(sorted(set(words), key=lambda w: (-len(w), w))) + ")"
    named = {
        "#HARM": either(inflected(HARM)), "#PAST": either(_PAST), "#BODY": either(BODY), "#KIN": either(KIN), "#AIMDEHUMAN": either(AIMED_DEHUMANISING), "#DEHUMAN": either(DEHUMANISING),
        "#GROUP": either(GROUPS), "#INSULT": either(plurals(INSULTS)), "#AIMED": either(plurals(AIMED_INSULTS)), "#DEGRADE": either(DEGRADING), "#STRONG": either([*STRENGTHENERS, *DEGRADING]),
    }
    for name, words in named.items():
        lines = lines.replace(name, words)
    return re.compile("|".join(f"(?:{x.strip()})" for x in lines.splitlines()))


def plurals(words: list[str]) -> list[str]:
    return [*words, *(w + ("es" if w.endswith(("s", "sh", "ch", "x")) else "s") for w in words)]


def inflected(verbs: list[str]) -> list[str]:
    """Verbs with their regular forms; the final consonant doubles after one vowel."""
    out = []
    for v in verbs:
        stem = v[:-1] if v.endswith("e") else v + v[-1] if len(v) < 6 and re.search(r"[^aeiou][aeiou][^aeiouwxyhkr]$", v) else v
        out += [v, v + ("es" if v.endswith(("s", "sh", "ch", "x")) else "s"), stem + "ed", stem + "ing"]
    return out


@functools.lru_cache(maxsize=1)
def _lists():
    """Word -> tag, word -> kinds of pattern worth trying, disguised spellings -> word, and masked shapes."""
    tag: dict[str, str] = {}
    for name, words in (
        ("insult", plurals(INSULTS)), ("f_abuse", FOREIGN_ABUSE), ("sexual", SEXUAL), ("dehuman", DEHUMANISING), ("aimed", plurals(AIMED_INSULTS)), ("degrading", DEGRADING), ("harm", inflected(HARM)),
        ("past", _PAST), ("f_sexual", FOREIGN_SEXUAL), ("f_hate", FOREIGN_HATE), ("aimed_sexual", AIMED_SEXUAL), ("group", GROUPS), ("aimed_dehuman", AIMED_DEHUMANISING), ("strong", STRENGTHENERS),
        ("p2", "you your u ur yours yourself yourselves you're".split()), ("p3", "he she they him her them his their whoever everyone he's she's they're".split()), ("p1", "i me my we us our i'm i'll myself".split()),
        ("body", BODY), ("kin", KIN), ("modal", "should must will ought shall gonna deserve deserves hope wish".split()),
    ):
        for w in words:
            tag.setdefault(w, name)
    also = {"dehuman": set(DEHUMANISING), "aimed_dehuman": set(AIMED_DEHUMANISING), "group": set(GROUPS), "aimed_sexual": set(AIMED_SEXUAL), "harm": set(inflected(HARM)), "past": set(_PAST), "sexual": set(SEXUAL),
            "f_abuse": set(FOREIGN_ABUSE), "f_hate": set(FOREIGN_HATE), "f_sexual": set(FOREIGN_SEXUAL)}
    kinds: dict[str, frozenset[str]] = {}
    for kind, words in TRIGGERS.items():
        for w in [*words.split(), *(x for t in TAG_TRIGGERS[kind].split() for x in also[t])]:
            kinds[w] = kinds.get(w, frozenset()) | {kind}
    for w in [*plurals(INSULTS), *plurals(AIMED_INSULTS), *DEGRADING]:
        kinds[w] = kinds.get(w, frozenset()) | {"aimed"}
    swapped, masked = {}, {}
    for w in [*INSULTS, *SEXUAL, *FOREIGN_ABUSE, *(x for x in (*AIMED_INSULTS, *AIMED_SEXUAL) if len(x) > 4)]:
        if 3 <= len(w):
            for k in range(1 if len(w) > 3 else 0, len(w) - 1):
                s = w[:k] + w[k + 1] + w[k] + w[k + 2 :]
                if s != w and s not in tag:
                    swapped.setdefault(s, w)
    for w in [*INSULTS, *SEXUAL, *FOREIGN_ABUSE, *AIMED_INSULTS, *AIMED_SEXUAL]:
        masked.setdefault((w[0], w[-1], len(w)), w)
    return tag, kinds, swapped, masked


LISTED = frozenset(("insult", "aimed", "sexual", "aimed_sexual", "f_abuse", "f_sexual"))


def _mend(text: str) -> str:
    """Undo UTF-8 that was read as a single-byte encoding."""
    if not _BROKEN.search(text):
        return text
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) < 256:
                out.append(ord(ch))
            else:
                return text
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:
        return text


def passages(text: str | None) -> list[str]:
    """Sentences and lines of the whole text; long ones are cut into overlapping windows."""
    if not text or not text.strip():
        return []
    out = []
    for piece in (p for line in _ENDS.split(html.unescape(text)) for p in _JOINED.split(line)):
        piece = piece.strip()
        if len(piece) < 2:
            continue
        if len(piece) <= 160:
            out.append(piece)
            continue
        words = piece.split()
        for at in range(0, max(1, len(words) - PASSAGE_TOKENS // 2), PASSAGE_TOKENS // 2):
            window = " ".join(words[at : at + PASSAGE_TOKENS])
            out += [window[k : k + 400] for k in range(0, len(window), 360)]
    return out


def _plain(token: str) -> tuple[str, bool]:
    """A token without disguise, and whether it was disguised."""
    tag, _, swapped, masked = _lists()
    if "**" in token:
        core = token.strip("*!+$")
        hit = masked.get((core[:1], core[-1:], len(core)))
        return (hit, True) if hit else (token, False)
    token = token.strip("'")
    bare = token.strip("!+*")
    hidden = False
    if bare and not bare.isalpha() and "'" not in bare and not ("+" in bare and sum(not c.isalpha() for c in bare) > 1) and (_LATIN.search(bare) or "$" in bare or "@" in bare):
        turned = bare.translate(_LEET)
        if turned.isalpha() and tag.get(turned) in LISTED:
            return turned, True
        also = token.rstrip("+*").translate(_LEET)
        if also.isalpha() and tag.get(also) in LISTED:
            return also, True
    if bare in swapped:
        return swapped[bare], True
    return bare, hidden


_MARKS = re.compile(r"[@$!*+\d]")


@functools.lru_cache(maxsize=200_000)
def _word(token: str) -> tuple[str, bool]:
    """A word without disguise, and whether it was disguised."""
    if _MARKS.search(token):
        return _plain(token)
    token = token.strip("'")
    swapped = _lists()[2]
    return (swapped[token], True) if token in swapped else (token, False)


@functools.lru_cache(maxsize=20_000)
def undisguise(passage: str) -> tuple[str, tuple[str, ...], bool]:
    """Lower-case text, its words, and whether a listed word was found only after undoing a disguise."""
    tag = _lists()[0]
    if passage.isascii():
        text = passage.translate(_ASCII).lower()
        if "<" in text:
            text = _TAG.sub(" ", text)
    else:
        text = _TAG.sub(" ", _INVISIBLE.sub("", _mend(passage)))
        text = unicodedata.normalize("NFKD", text).lower().translate(_LOOKALIKE)
        text = _INVISIBLE.sub("", "".join(c for c in text if c.isascii() or not unicodedata.combining(c) or "぀" <= c <= "ヿ"))
    hidden = False

    def close(m: re.Match) -> str:
        if m.group(0).count(" ") and re.search(r"[.\-_*/]", m.group(0)):  # blanks between words that are pulled apart otherwise
            return " ".join(close_plain(x) for x in re.findall(r"[^\W\d_](?:[.\-_*/][^\W\d_])+|[^\W\d_](?: [^\W\d_](?![.\-_*/]))*", m.group(0)))
        return close_plain(m.group(0))

    def close_plain(spelt: str) -> str:
        nonlocal hidden
        word = re.sub(r"[ .\-_*/]", "", spelt)
        for lead in ("", "a", "i", "u"):
            if word.startswith(lead) and tag.get(word[len(lead) :]) in LISTED:
                hidden = True
                return f"{lead} {word[len(lead) :]}".strip()
        return word

    text = _SPACED.sub(close, text)
    squeezed = _RUN.sub(r"\1", text)
    if squeezed != text:
        found = {w for w in _WORD.findall(squeezed) if tag.get(w) in LISTED}
        text, hidden = squeezed, hidden or bool(found.difference(_WORD.findall(text)))
    read = [_word(w) for w in _WORD.findall(text)]
    hidden = hidden or any(was for _, was in read)
    words = tuple(w for w, _ in read)
    return (" ".join(words) if hidden else text), words, hidden

AIMED = r"""\b(?:you|u|ya|ur|you're|you are)(?: are| r| were|'re)?(?: all| people| lot| guys| two)?(?: just| nothing but| no more than| being| still)?(?: such)?(?: an?| the| one)?(?: (?:#STRONG))*,? (?:#INSULT|#AIMED)\b(?! (?:\w+ing|shaped|print))
\b(?:he|she|they|whoever|everyone|everybody|all of (?:them|you)|(?:that|this|the) (?:man|woman|guy|girl|boy|lady|driver|manager|boss|clerk|seller|buyer|agent|colleague|person|cashier|idiot|team|crew)|(?:your|his|her|their) (?:\w+ ){1,3}?)(?: \w+){0,4}?\s?(?:is|are|'s|'re|was|were) (?:all |just |nothing but |no more than |such |still )?(?:an? |the |one |some )?(?:(?:#STRONG) )*(?:#INSULT|#AIMED)\b(?! (?:\w+ing|shaped|print|from|of the month))
\bthe (?:(?:#STRONG) )*(?:#AIMED|#INSULT) (?:in|from|at|on|who|that|behind|over) [^.!?]{1,50}\b(?:should|must|deserves?|needs? to|ought to|can go)\b(?! (?:be (?:replaced|cleaned|washed|repaired|stored|sold|shipped|packed|delivered|returned|kept)))
\b(?:what an?|such an?|only an?|typical for an?|typical of an?|like an?|listen|shut up|look|bye|thanks|well),? (?:you )?(?:(?:#STRONG) )+(?:#INSULT|#AIMED)\b|\b(?:complete|absolute|total|utter|fucking|goddamn|pathetic|worthless) (?:(?:#STRONG) )*(?:#AIMED|#INSULT)\b(?! (?:of (?:the|a|time|money)|delivery|packaging|price|service))
\b(?:you|u|you're|he|she|he's|she's|you people|you all|you lot|your (?:\w+ )?(?:boss|team|mother|father|wife|husband|family|colleagues?|staff|face|brain|kids?))(?: are| is|'re|'s| r)?(?: all| just| both)? (?:(?:so|too|such|very|really|just|completely|totally|utterly|absolutely|fucking|bloody|damn|a|an) )*(?:pathetic|worthless|disgusting|stupid|dumb|ugly|fat|vile|despicable|contemptible|brainless|spineless|ignorant|repulsive|revolting|hideous|hopeless|moronic|idiotic|gormless|witless|mindless|brain-?dead|inbred|loathsome|pitiful|laughable|useless|incompetent|retarded|filthy|lazy|shameless|gutless|subhuman|soulless)\b(?! (?:at|with|to hear|box|lid|question|mistake|thing))"""
_CONTEXTS = {
    name: _compiled(lines) for name, lines in (("threat", THREAT), ("call", CALL), ("wish", WISH), ("contempt", CONTEMPT), ("hate", HATE), ("advance", ADVANCE), ("foreign", FOREIGN), ("aimed", AIMED), ("harmless", HARMLESS))
}
_NEAR_PERSON = frozenset(("p1", "p2", "p3", "body", "kin"))


def _beside(tags: list[str | None], what: str, who: frozenset[str], reach: int = 3) -> bool:
    """Whether a word of the tag ``what`` has one of ``who`` within ``reach`` words."""
    return any(t == what and not who.isdisjoint(tags[max(0, k - reach) : k + reach + 1]) for k, t in enumerate(tags))


def matched(text: str, words: tuple[str, ...]) -> set[str]:
    """The kinds of pattern that occur in an undisguised text; only those that one of its words calls for are tried."""
    kinds = _lists()[1]
    likely = set().union(*(kinds[w] for w in words if w in kinds))
    return {kind for kind in likely if _CONTEXTS[kind].search(text)}


VOTERS = (
    "insult", "insult_aimed", "insult_with_degrading", "insult_disguised", "sexual_word", "sexual_of_person", "sexual_advance", "group_dehumanised", "hate_phrase",
    "threat", "call_for_harm", "ill_wish", "contempt", "foreign_abuse", "foreign_sexual", "foreign_hate", "foreign_phrase", "harmless_sense", "raters",
)
#: The kind of harm each voter stands for: insults, sexual, hate, threats, contempt, other languages; harmless senses and raters stand for none.
KINDS = (0, 0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 3, 4, 5, 5, 5, 5, 0, 0)
_NOTHING = "-" * len(VOTERS)


def votes(passage: str, rated: float | None = None) -> str:
    """A letter per voter: h harmful, s harmless, - no opinion."""
    text, words, hidden = undisguise(passage)
    return _ballot(passage, text, words, hidden, tags_of(words), rated)


def tags_of(words: tuple[str, ...]) -> list[str | None]:
    tag = _lists()[0]
    return [tag.get(w) for w in words]


def _ballot(passage: str, text: str, words: tuple[str, ...], hidden: bool, tags: list[str | None], rated: float | None) -> str:
    has = set(tags)
    cjk = not passage.isascii()
    abuse = "f_abuse" in has or cjk and any(w in passage for w in JAPANESE_ABUSE)
    lewd = "f_sexual" in has or cjk and any(w in passage for w in JAPANESE_SEXUAL)
    found = matched(text, words)
    foreign = "foreign" in found
    hostile = len({w for w, k in zip(words, tags) if k == "f_hate"}) > 1 or "f_hate" in has and (abuse or foreign)
    of_person = "aimed_sexual" in has and _beside(tags, "aimed_sexual", _NEAR_PERSON, 2)
    listed = not has.isdisjoint(("insult", "sexual")) or hidden and not has.isdisjoint(LISTED) or abuse or lewd or hostile
    if not listed and not found and not of_person:
        return _rated(_NOTHING, rated)
    benign = bool(_CONTEXTS["harmless"].search(text))
    plain = not benign
    degraded = any(a in ("degrading", "strong") and b in ("insult", "aimed") and (b == "insult" or a == "degrading" and "aimed" in found) for a, b in zip(tags, tags[1:]))
    grouped = "group" in has and ("dehuman" in has or "aimed_dehuman" in has and "hate" in found)
    marks = (
        "insult" in has and plain,
        "aimed" in found and plain,
        degraded and plain,
        hidden and not has.isdisjoint(LISTED),
        "sexual" in has and plain,
        of_person and plain and ("advance" in found or "sexual" in has),
        "advance" in found and plain,
        grouped and plain,
        "hate" in found and plain,
        "threat" in found,
        "call" in found and plain,
        "wish" in found and plain,
        "contempt" in found and plain,
        abuse,
        lewd,
        hostile,
        foreign,
    )
    return _rated("".join("h" if m else "-" for m in marks) + ("s-" if benign else "--"), rated)


def _rated(ballot: str, rated: float | None) -> str:
    """A ballot with the raters' vote, who speak of whole documents: harmful only where another voter says so of the passage."""
    if rated is None or rated == 0.5:
        return ballot
    return ballot[:-1] + ("s" if rated < 0.5 else "h" if "h" in ballot[:-2] else "-")


# ---------------------------------------------------------------- label model
@dataclass(frozen=True)
class LabelModel:
    """A tree over the voters within each class: class 0 is harmless, each other a kind of harm.

    ``table[i, c, p, v]`` is log P(voter i says v | class c, its parent says p); voters without a
    parent have the same entries for every p.  ``shares`` are the classes' shares of all
    passages.  ``weight`` tells how much of a voter's say is its own: 1 for one that leans on no
    other, less the better its closest relative foretells it.
    """

    table: np.ndarray
    parent: np.ndarray  # per voter the voter it leans on, or -1
    weight: np.ndarray
    shares: np.ndarray

    @property
    def prior(self) -> float:
        return float(1 - self.shares[0])

    def classes(self, patterns: list[str]) -> np.ndarray:
        """P(class | votes), a row per pattern."""
        v = _codes(patterns)
        above = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 2)
        said = self.table[np.arange(v.shape[1]), :, above, v].sum(axis=1) + np.log(self.shares)
        chance = np.exp(said - said.max(axis=1, keepdims=True, initial=-np.inf))
        return chance / chance.sum(axis=1, keepdims=True)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        return 1 - self.classes(patterns)[:, 0]


def _codes(patterns: list[str]) -> np.ndarray:
    width = len(patterns[0]) if len(patterns) else len(VOTERS)
    return np.array([["hs-".index(c) for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), width)


def _leaning(joint: np.ndarray, shares: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Parents of a maximum spanning forest over the voters' mutual information within classes, and each voter's own weight.

    ``joint[c, i, a, j, b]`` is the share of passages of class c, itself a share ``shares[c]`` of
    all, in which i says a and j says b.
    Pairs that share less than ``least`` of either one's uncertainty are not linked.
    """
    voters = joint.shape[1]
    single = np.einsum("ciaia->cia", joint)
    product = single[:, :, :, None, None] * single[:, None, None, :, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        shared = np.where(joint > 0, joint * np.log(joint / np.maximum(product, 1e-300)), 0.0).sum(axis=(2, 4))
        doubt = -np.where(single > 0, single * np.log(np.maximum(single, 1e-300)), 0.0).sum(axis=2)
    part = (shared / np.maximum(np.minimum(doubt[:, :, None], doubt[:, None, :]), 1e-12))[shares >= shares[1:].max() / 10].max(axis=0)
    both = (shared * shares[:, None, None]).sum(axis=0)
    np.fill_diagonal(part, 0)
    parent, inside = np.full(voters, -1), np.zeros(voters, dtype=bool)
    for _ in range(voters):
        reach = np.where(inside[:, None] & ~inside[None, :] & (part >= least), both, -1.0)
        i, j = np.unravel_index(np.argmax(reach), reach.shape)
        if reach[i, j] <= 0:
            j = int(np.argmin(inside))  # a new tree
        else:
            parent[j] = i
        inside[j] = True
    return parent, 1 / (1 + np.clip(part.max(axis=1), 0, 1))


def fit_label_model(patterns: list[str], counts: np.ndarray, kinds: tuple[int, ...] | None = None, rounds: int = 40, prior: float = 0.02, least: float = 0.1, smooth: float = 0.5) -> LabelModel:
    """Expectation maximisation over vote patterns with their counts.

    Passages are harmless or of one of several kinds of harm, since a voter for insults has no
    say on threats; ``kinds`` names each voter's kind at the start (one for all by default).
    Within a class each voter leans on at most one other (the links of a maximum spanning forest
    over mutual information), so both accuracies and pairwise terms are estimated, and a voter
    that repeats another adds nothing.  A vote is held to be right more often than by chance; no
    opinion is a vote like any other.  The share of harmful passages is estimated too; ``prior``
    only serves an empty table.  Starts from a majority vote in which no opinion counts as harmless.
    """
    v, n = _codes(patterns), np.asarray(counts, dtype=float)
    voters = v.shape[1]
    kinds = kinds or (0,) * voters
    parts = max(kinds) + 1
    if not len(v):
        return LabelModel(np.zeros((voters, 1 + parts, 3, 3)), np.full(voters, -1), np.ones(voters), np.array([1 - prior, *[prior / parts] * parts]))
    harmful, harmless = (v == 0).sum(axis=1), (v == 1).sum(axis=1)
    calls = np.stack([((v == 0) & (np.array(kinds) == k)).sum(axis=1) for k in range(parts)], axis=1)
    q = np.where(harmful > harmless, 0.9, 0.001)[:, None] * (calls + 1e-3) / (calls + 1e-3).sum(axis=1, keepdims=True)
    q = np.concatenate([1 - q.sum(axis=1, keepdims=True), q], axis=1)  # pattern, class
    one_hot = np.stack([(v == k) for k in range(3)], axis=2).astype(float).reshape(len(v), -1)  # pattern, voter and vote
    model = None
    for _ in range(rounds):
        mass = (q * n[:, None]).T  # class, pattern
        counted = np.stack([(one_hot * m[:, None]).T @ one_hot for m in mass]).reshape(1 + parts, voters, 3, voters, 3)
        total = np.maximum(mass.sum(axis=1), 1e-9)
        parent, weight = _leaning(counted / total[:, None, None, None, None], total / total.sum(), least)
        single = np.einsum("ciaia->cia", counted) + smooth
        rate = single / single.sum(axis=2, keepdims=True)
        table = np.repeat(np.log(rate).transpose(1, 0, 2)[:, :, None, :], 3, axis=2)
        for i in np.nonzero(parent >= 0)[0]:
            pair = counted[:, parent[i], :, i, :] + 3 * smooth * rate[:, i, None, :]  # few cases lean on the voter's own rates
            table[i] = np.log(pair / pair.sum(axis=2, keepdims=True))
        over = np.log((np.exp(table[:, 1:]) * total[None, 1:, None, None]).sum(axis=1) / total[1:].sum())
        table[:, 0, :, 0] = np.minimum(table[:, 0, :, 0], over[:, :, 0])
        table[:, 1:, :, 1] = np.minimum(table[:, 1:, :, 1], table[:, :1, :, 1])
        model = LabelModel(table, parent, weight, np.maximum(total / total.sum(), 1e-9))
        q = model.classes(patterns)
    return model


# ---------------------------------------------------------------- classifier
@functools.lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs in their order, spread over the high bits too."""
    x = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
    return x ^ (x >> np.uint32(15))


@functools.lru_cache(maxsize=50_000)
def _ballot_features(ballot: str) -> tuple[int, ...]:
    """Of the votes, without the raters', who say nothing about unrated documents."""
    if ballot[:-1] == _NOTHING[:-1]:
        return (_hash("v none"),)
    return tuple(_hash(f"v {k}{c}") for k, c in enumerate(ballot[:-1]) if c != "-")


def features(passage: str, ballot: str) -> np.ndarray:
    """Hashed words, neighbours, tags in their order and votes of a passage, as distinct 16-bit numbers.

    Tags stand for whole word lists, so what is learnt of them holds for words that no passage had.
    """
    _, words, _ = undisguise(passage)
    return feature_rows([passage], [words], [tags_of(words)], [ballot])[0]


def feature_rows(passages_: list[str], words: list[tuple[str, ...]], tags: list[list[str | None]], ballots: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All passages' features one after another, and how many each has."""
    owner, code = [], []

    def put(own: np.ndarray, hashes: np.ndarray, pairs: bool) -> None:
        owner.append(own)
        code.append(hashes)
        if pairs and len(own) > 1:
            same = own[:-1] == own[1:]
            owner.append(own[1:][same])
            code.append(_mixed(hashes[:-1], hashes[1:])[same])

    def each(lists: list, pairs: bool) -> None:
        own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        put(own, np.array([h for x in lists for h in x], dtype=np.uint32), pairs)

    each([[_hash(w) for w in x] for x in words], True)
    each([[_hash("t " + t) for t in x if t] if "h" in b[:-1] else [] for x, b in zip(tags, ballots)], True)
    cjk = [[] if p.isascii() else [c for c in p if "぀" <= c <= "鿿"] for p in passages_]
    each([[_hash(f"c{a}{b}") for a, b in zip(x, x[1:])] for x in cjk], False)
    each([_ballot_features(b) for b in ballots], False)
    both = np.unique(np.concatenate(owner).astype(np.int64) << 16 | (np.concatenate(code) & np.uint32(DIMENSIONS - 1)))
    return (both & 0xFFFF).astype(np.uint16), np.bincount(both >> 16, minlength=len(passages_))


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, dtype=np.int64)
        z = np.bincount(own, weights=self.weights[at], minlength=len(rows)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_classifier(rows: list[np.ndarray] | list[list[int]], target: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> Classifier:
    """Logistic regression on posterior labels by adaptive gradient steps over small batches."""
    w, b = np.zeros(DIMENSIONS), -2.0
    speed = np.full(DIMENSIONS, 1e-2)
    rng = np.random.default_rng(seed)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if len(rows) else np.empty(0, dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    for _ in range(epochs if len(rows) else 0):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            own = np.repeat(np.arange(len(part)), lengths[part])
            at = np.concatenate([flat[begins[p] : begins[p + 1]] for p in part])
            z = np.bincount(own, weights=w[at], minlength=len(part)) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) * weight[part]
            step = np.bincount(at, weights=error[own], minlength=DIMENSIONS)
            used = np.unique(at)
            g = step[used] / len(part) + decay * w[used]
            speed[used] += g * g
            w[used] -= rate * g / np.sqrt(speed[used])
            b -= rate * 0.1 * error.mean()
    return Classifier(w, b)


# ---------------------------------------------------------------- on Spark
def best_cut(rated: DataFrame) -> float:
    """The score between harmless and harmful at which raters and scores agree best (by F1), 0.5 without cases of both.

    ``rated`` has ``score`` and ``harmful`` of each labelled document.  Documents are counted per
    score and the counts summed over range-sorted scores, so however many there are all count.
    """
    each = rated.groupBy("score").agg(F.count("*").alias("n"), F.count_if("harmful").alias("h"))
    each = cut(each.withColumns({"_all": F.lit(0), "_down": -F.col("score")}))
    n, h = each.agg(F.sum("n"), F.sum("h")).first()
    if not n or h in (0, n):
        return 0.5
    sums = range_prefix_sums(each, ["_all"], ["_down"], {"taken": "n", "hit": "h"})
    s = sums.agg(F.max(F.struct((2 * F.col("hit") / (F.col("taken") + h)).alias("f1"), "score")).alias("m")).first()["m"]["score"]
    below = each.where(F.col("score") < s).agg(F.max("score").alias("below")).first()["below"]
    return float(np.clip(np.sqrt(s * max(s / 2 if below is None else below, 1e-6)), 1e-4, 0.99))


def voted_passages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``rated`` (share of raters who say harmful, or null), ``ballot`` and ``features`` of each passage.

    Each document's passages come once, however often it repeats them.  Features are 16-bit
    numbers as bytes, shorter than the text they come from.
    """
    rated = labels.where(F.col("harmful").isNotNull()).groupBy("doc_id").agg(F.avg("harmful").alias("rated"))
    small = spread(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id").join(rated, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, said, at, known = [], [], [], {}
            for doc, text, share in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "rated"))):
                own = [known.setdefault(p, len(known)) for p in dict.fromkeys(passages(text))]
                at += own
                ids += [doc] * len(own)
                said += [share] * len(own)
            own = list(known)  # each passage of the batch is read once, however many documents hold it
            read = [undisguise(p) for p in own]
            tags = [tags_of(words) for _, words, _ in read]
            ballots = [_ballot(p, plain, words, hidden, tagged, None) for p, (plain, words, hidden), tagged in zip(own, read, tags)]
            rows, counts = feature_rows(own, [words for _, words, _ in read], tags, ballots)
            at = np.array(at, dtype=np.int64)
            size = counts[at]
            first = np.repeat((np.cumsum(counts) - counts)[at] - (np.cumsum(size) - size), size)
            ends = np.concatenate([[0], np.cumsum(size) * 2]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows[first + np.arange(len(first))].tobytes())])
            rated = pa.array([_rated(ballots[k], share) for k, share in zip(at.tolist(), said)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.float64()), rated, packed], names=["doc_id", "rated", "ballot", "features"])

    return small.mapInArrow(run, "doc_id bigint, rated double, ballot string, features binary")


def fit(voted: DataFrame, fit_passages: int = FIT_PASSAGES) -> tuple[LabelModel, Classifier]:
    """Fit both models.  Vote patterns are counted over all passages; there are few of them.

    The classifier learns from distinct passages and their pattern's posterior, at most
    ``fit_passages`` in the order of a hash: half of them from passages with votes, half from
    the others of labelled documents.
    """
    counted = voted.groupBy("ballot").agg(F.count("*").alias("n")).toPandas().sort_values("ballot")
    model = fit_label_model(counted["ballot"].tolist(), counted["n"].to_numpy(), KINDS)
    said = F.substring("ballot", 1, len(VOTERS) - 1) != _NOTHING[:-1]
    one = voted.where(said | F.col("rated").isNotNull()).groupBy("features").agg(F.min("ballot").alias("ballot"), F.max(said).alias("said"), F.count("*").alias("n"))
    some = lambda rows: rows.orderBy(F.xxhash64("features"), "features").limit(fit_passages // 2)
    one = cut(one)
    sample = some(one.where("said")).unionByName(some(one.where("not said"))).toPandas().sort_values("features")
    x = [np.frombuffer(f, dtype=np.uint16) for f in sample["features"]]
    target = model.posterior(sample["ballot"].tolist()) if len(sample) else np.empty(0)
    times = np.sqrt(np.minimum(sample["n"].to_numpy(dtype=float), 100.0))  # a passage that many documents hold counts more
    harmful = max((target * times).sum(), 1.0)
    balance = np.where(target > 0.5, min(20.0, max(1.0, (times.sum() - harmful) / harmful / 2)), 1.0) * times
    return model, fit_classifier(x, target, balance)


def score_documents(docs: DataFrame, labels: DataFrame, fit_passages: int = FIT_PASSAGES) -> DataFrame:
    """``doc_id``, ``source`` and ``score`` (0 to 1) of every document: that of its worst passage.

    Scores are moved so that raters of labelled documents agree best with a limit of 0.5.
    Whole texts are read.  Null, empty and blank texts score 0.  Repeated documents score
    alike; a null ``doc_id`` counts as one document; an empty table gives no rows and missing
    labels only mean that the raters have no say.  Without labelled passages the classifier
    stays at its bias and every document's score is low.  Columns beside doc_id, text and
    source are not read.
    """
    voted = cut(voted_passages(docs, labels))
    _, classifier = fit(voted, fit_passages)
    weights, bias = classifier.weights.astype(np.float32), classifier.bias
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))  # DIMENSIONS numbers, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Classifier(*shared.value)
        for batch in batches:
            scores = model.score([np.frombuffer(f, dtype=np.uint16) for f in batch["features"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores}).groupby("doc_id", dropna=False, as_index=False)["score"].max()

    worst = voted.select("doc_id", "features").mapInPandas(run, "doc_id bigint, score double").groupBy("doc_id").agg(F.max("score").alias("score"))
    ids = docs.groupBy("doc_id").agg(F.min("source").alias("source"))
    joined = ids.join(worst.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    scored = cut(joined.select("doc_id", "source", F.coalesce("score", F.lit(0.0)).alias("score")))
    rated = labels.where(F.col("harmful").isNotNull()).groupBy("doc_id").agg(F.avg("harmful").alias("rated")).where(F.col("rated") != 0.5)
    at = best_cut(scored.join(rated, "doc_id").select("score", (F.col("rated") > 0.5).alias("harmful")))
    clear = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-9)), F.lit(1e-9))
    shifted = 1 / (1 + F.exp(-(F.log(clear / (1 - clear)) - math.log(at / (1 - at)))))
    return scored.select("doc_id", "source", F.when(F.col("score") > 0, shifted).otherwise(0.0).alias("score"))


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, harmful documents and their share per source; a null source is one of its own."""
    harmful = F.count(F.when(F.col("score") >= threshold, 1))
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), harmful.alias("n_harmful"), (harmful / F.count("*")).alias("rate"))
