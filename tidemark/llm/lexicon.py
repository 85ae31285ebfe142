"""Weighted phrases of abusive, hateful and sexual language, rules on their context, and phrases that excuse them.

Fixed values, written for this library from common usage, in folded spelling: lower
case, no accents, punctuation as spaces.  A star at the end stands for any ending.
Weight 1 is enough by itself; a half needs another half nearby in its sentence.
"""

#: words that insult by themselves
INSULTS = """
arse arsehole arseholes ass asses asshole assholes asshat bastard bastards bitch bitches bitching bollocks braindamaged brainless
cocksucker cretin cretins cripples cunt cunts dickhead dickheads dimwit dipshit dipshits dirtbag douchebag dumbass dumbasses dyke
fag faggot faggots fatass fucker fuckers fuckface fuckwit goddamn halfwit idiot idiots imbecile imbeciles jackass kys moron morons
motherfucker motherfuckers nigger niggers nitwit numbskull pervert piss prick pricks pussy retard retarded retards scumbag scumbags
scum shithead shitheads shithole shitty slag slut sluts slutty spastic stfu subhuman subhumans tosser twat twats untermensch vermin
wanker wankers whore whores whoring wop
cabron cabrones chingar cono culero estupida estupido gilipollas hijoputa hijueputa idiotas imbecil imbeciles joder jodete malparido
maricon maricones mierda pendejo pendeja pendejos puta putas puto putos subnormal tarado zorra zorras
arrombado arrombada babaca babacas bicha bosta buceta burra burro caralho corno cuzao desgracado foda fodase foder fudido idiotice
merda otario otaria otarios piranha porra puto retardado vagabunda vagabundo vagabundas viado viados
abruti abrutie abrutis batard batards bouffon connard connards connasse connasses conne debile encule encules enfoire enfoires
fiotte gouine merde merdeux negre ordure pede petasse pouffiasse pute putes salaud salauds salope salopes salopard tapette tocard
abschaum affe arsch arschgeige arschloch arschlocher bastarde bloedmann depp deppen dreckige dreckiger dreckiges dreckssau drecksack
dummkopf fickt fotze fotzen hure huren hurensohn hurensohne idiotin kanake kanaken kruppel mistkerl mistgeburt missgeburt
nutte nutten saftsack schlampe schlampen schwachkopf schwachkopfe schwuchtel spast spasti trottel ungeziefer vollidiot wichser ziegenficker
hirnlos hirnlose hirnloser
fuck fucked fucking fucks shit bullshit crap nudes porn porno pornographic tits boobs blowjob handjob cumshot cum jizz milf dildo
horny panties orgasm masturbate masturbating threesome gangbang hardcore clit naked nackt nacktbilder geile geiler geil ficken fick
titten muschi schwanz pelada pelado gostosa gostosas punheta boquete nua nudes baise baiser niquer nique seins bite chatte
desnuda desnudas tetas polla follar follarte follo coger verga culo
"""

#: derived plurals that are words of their own and harmless
NO_PLURALS = "baises dykes pedes scums ordures buffs cons bites coger pricks debiles crapes slags"

#: short words that are matched with two letters swapped, as longer ones are
SWAPPED = "bitch idiot moron whore"

#: of these, what is too common in harmless text to be enough alone
HALF = """
ass asses goddamn bite chatte coger cum crap damn naked nackt hardcore geil affe burro burra bicha corno cono piranha culo nua seins scum
schwanz slag debile ordure prick piss bullshit shitty depp bouffon puto dyke wop bastard affe verga conne hell
creature filthy pathetic worthless useless stupid ugly disgusting miserable lying greasy spineless fat braindead brain dead pig pigs rat rats cockroach
cockroaches parasite parasites animals loser losers clown clowns trash garbage lowlife freak psycho roadkill moronic idiotic imbecilic
inutil nojento nojenta asco sucio sucia asqueroso asquerosa cerdo cerda porco porca lixo inutile degueulasse sale porc
rebut widerlich widerlicher widerliche sau schwein schweine drecks dumm dumme dummer ratte ratten parasiten racaille cafard cafards
"""

#: common phrases that mean harm only beside another cue: weight a half
CONTEXT = """
laughs at; even a dog; better than you; than you do; born with; waste of space; waste of a; despise you; despises you; count to ten; count to three; ashamed of you; ashamed of him; ashamed of her; if stupidity; more sense than; burn down; die of cancer; crawl back
crawled back; came from; touch a keyboard; brain is smaller; brain of a; dog understands; ugly face; your ugly; a rope; blood on the; bring a knife; bring a gun; everyone inside; a bullet
under the ground; bleed out; bleed like; like a dog; like dogs; rabid dogs; put down; a burden; never wake up; in a ditch; house burns; your house; watch your; spit on; hold a pen; by blood; every last one; civilised people
decent people; infected; on her back; a stove; wiped out; their kind; never trust; are animals; breed like; stink of; smell like; filth wherever; their children; even more so; uncensored; girls waiting; waiting for you; bring toys
wear under; what you wear; under that suit; my hotel room; my hotel; sleep with; sex with; sex for; take off your; take off her; your bra; inside you; wet lips; spanking; on your knees; dream about your; get hard; got hard
every time; bends over; bend over; show me your; all night; tonight; no strings; hormones; strip for; on the beach; up her skirt; under her skirt; her skirt; that ass; your ass; full clip; think with; toda la noche; toute la nuit
noite inteira; ganze nacht; zieh dich aus; a poil; la vermine; vermine; dans le sang; im blut; la vaisselle; la cocina; na cozinha; pra cozinha; den herd; ins lager; stinken; puent; dehors; fora todos; fuera todos; uma praga
una mujer; uma mulher; une femme; eine frau; les eliminer; vai pegar fogo; del puente; da ponte; tirate; morra; creve; stirb; que da asco; nojo; tira a blusa; tira a roupa; la ropa; sucer; photos de toi; nichts wert; raus mit
rentrez chez; voltem para; sua casa; tu casa; en la sangre; no sangue
"""

#: words that insult whom they are said to, or said of
ADDRESSED = """
worthless useless pathetic stupid ugly disgusting filthy miserable lying greasy spineless fat braindead dumb brainless revolting repulsive vile pig pigs rat rats cockroach cockroaches parasite parasites loser losers clown clowns
trash garbage filth vermin lowlife freak psycho moronic idiotic imbecilic waste disgrace failure coward creep snake worm maggot swine animal animals
inutil nojento nojenta sucio sucia asqueroso asquerosa cerdo cerda basura porco porca lixo inutile degueulasse sale porc rebut dechet widerlich dumm schwein ratte abschaum dreck schifoso schifosa inutile
"""
#: how a person is addressed, what may stand between, who is spoken of as a group
YOU = "you u youre ur tu eres usted voce vc vous du ihr sie bist seid sei"
BETWEEN = "are re r a an such the so really just nothing but absolute absolutely complete completely total totally utter all people lot bunch of little fucking bloody damn and es un una tan so muy e uma tao muito es une si tres bist ein eine einfach nur so ein sei un una"
GROUPS = "women woman girls girl females foreigners foreigner immigrants immigrant migrants refugees jews muslims arabs blacks whites asians mexicans gypsies gays lesbians homosexuals transsexuals cripples disabled christians africans indians chinese"

#: verbs of violence, ends that are wished on people, and what is said of groups one hates
VIOLENCE = "kill murder gut strangle stab shoot beat burn hurt rape break cut slit smash bash end bury choke hang drown skin crush destroy find"
ENDS = "die dies suffer suffers rot rots choke chokes bleed bleeds burn burns drown drowns perish perishes hang hangs dead cancer killed"
DEGRADED = "vermin parasites cockroaches subhuman animals rats scum filth dirt thieves criminals liars disease plague pigs dogs apes monkeys savages degenerates trash garbage terrorists inferior"

#: insults, threats, wishes of harm
HARM = """
waste of space; you disgusting; you filthy; you pathetic; you worthless; you stupid; you useless; you ugly; you miserable; you greasy; you spineless; you fat; you lying; you goddamn; too stupid to; go to hell; burn in hell
drop dead; eat shit; shut your mouth; shut up you; shut the; choke on that; choke on them; choke on it; choke on your; get cancer; die slowly; die in a fire; die in pain; die alone; kill yourself; kill your self
hang yourself; shoot yourself; end yourself; drown yourself; slit your wrists; off yourself; step in front of a train; jump off a bridge; jump off a roof; jump off a building; drink bleach; nobody would miss you
no one would miss you; stopped breathing; do everyone a favour and; do everyone a favor and; do the world a favour and; do us all a favour and; going to kill you; cut your throat; slit your throat; break your legs; break your neck
break every bone; smash your; bash your; put a bullet; know where you live; have your address; where you sleep; where your children; where your kids; your children go to school; burn your house; burn down your; watch your back
you will bleed; acid in your face; find you in the parking; should be shot; should be hanged; should be hung; should be beaten; should be put down; should be sterilised; should be sterilized; should be gassed; should be wiped out
should be exterminated; should be burned; should be deported; should be drowned; should be whipped; should be lynched; should be raped; sick dogs; six feet under you; your kids will pay; your family will pay
your children will pay; pay with your life; you will pay for it with; put down like; beaten until; te vamos a matar; te voy a matar; voy a matarte; vamos a matarte; ojala te mueras; ojala se muera; ojala te mates; muerete
que te mueras; te mueras; te pudras; sabes donde vives; se donde vives; sabemos donde vives; quemaremos tu; quemar tu casa; romperle las piernas; romperte las piernas; romperte la cara; te rompo la cara; te parto la cara
te corto el cuello; nadie te echaria de menos; cortate las venas; pegate un tiro; ahorcate; hijo de puta; hija de puta; hijos de puta; hijo de perra; cierra la boca; callate la boca; vete al infierno; vete a la mierda; a la mierda
me cago en; basura humana; no vales nada; vou te matar; vamos te matar; tomara que voce morra; tomara que morra; espero que voce morra; que voce morra; se mata; sei onde voce mora; sabemos onde voce mora; sua casa vai pegar fogo
pula da ponte; pule da ponte; ninguem vai sentir sua falta; quebrar suas pernas; quebrar as pernas; quebrar a sua cara; quebrar sua cara; te quebrar; meter uma bala; leva uma bala; filho da puta; filha da puta; filhos da puta
cala a boca; cala essa boca; vai se foder; vai tomar no; tomar no cu; lixo humano; devia apanhar; merece apanhar; merece morrer; devia morrer; je vais te tuer; on va te tuer; va te tuer; je vais te casser; te casser la gueule
casser les jambes; te crever; va crever; va mourir; va te pendre; pends toi; saute du toit; saute du pont; saute d un pont; jette toi; personne ne te regrettera; rends service a tout le monde; je sais ou tu habites
on sait ou tu habites; sais ou tu habites; bruler ta maison; ta maison va bruler; brulera ta maison; j espere que tu creves; j espere que tu vas; fils de pute; fille de pute; ferme ta gueule; ta gueule; va te faire; nique ta
casse toi; espece de; sale pute; sale con; pauvre con; gros con; petit con; une balle dans; merite la mort; merite de crever; qu il creve; qu elle creve; dechet humain; ich bring dich um; ich bringe dich um; bringen dich um
ich weiss wo du wohnst; ich wei wo du wohnst; wissen wo du wohnst; wo du wohnst; brennt dein haus; dein haus brennt; dein haus anzunden; ich schlag dich; schlage dich; schlag dir; gehort erschlagen; gehoren erschlagen
gehort erschossen; gehoren erschossen; gehort aufgehangt; gehoren ausgerottet; gehort vergast; gehoren vergast; geh sterben; geh verrecken; verreck; verrecke; verrecken; krepier; krepiere; krepieren; stirb endlich; hang dich auf
erhang dich; bring dich um; von der brucke springen; spring von der; keiner vermisst dich; niemand vermisst dich; halt die fresse; halt dein maul; halts maul; fresse polieren; verpiss dich; fick dich; fahr zur holle; du dummes
du dumme; du dummer; du widerlich*; du dreckig*; du elend*; du miese*; verschwendung von sauerstoff; kugel in den kopf; the day you are under the ground; with more sense than; your brain is smaller; never touch a keyboard; should have been put down; put down at birth; hope you get hit; hope you get run over; hope you get shot; hope you get raped; hit by a bus and die
tirate por la; tirate de un; tirate del; deberias saltar; pular da ponte; pule de; te joga da; morra logo; morra sozinho; stirb; stirb endlich; du bist nichts wert; ihr seid nichts wert; creve donc; tu peux crever; va crever; hay que eliminarlos; il faut les eliminer; faut les eliminer; devrait mourir; deberias morirte; nojo dessa; nojo desse; que asco de; me das asco; me da asco
the day you die; the day you are dead; i bring a knife; i bring a gun; i ll bring a gun; i will bring a gun; check under your car; job on her back; waste of skin; waste of oxygen; waste of air; there will be blood on; despise you all; everybody hates you; everyone hates you; nobody loves you; nobody likes you
nobody wants you here; the world is better without you; better off without you; better off dead; go die; just die; please die; die already; kill urself; kys now; neck yourself; unalive yourself; i hate you; you make me sick
you people make me sick; you are nothing; you re nothing; worth nothing to anyone; piece of shit; piece of trash; piece of garbage; pile of shit; sack of shit; sorry excuse for a human; oxygen thief; bellend; bellends; knobhead
knobheads; shitstain; fuckboy; dumbfuck; arsewipe; asswipe; prat; gobshite; pissant; degenerate scum; human garbage; human trash; subhuman filth; i know where you; we know where you; i know your address; sleep with one eye open
dig your grave; you re dead; you are a dead man; dead man walking you; count your days; your days are numbered; i will end you; i will destroy your life; i will make you suffer; make you pay in blood; beg for your life
beg for mercy; skin you alive; burn you alive; bury you alive; beat you to death; bash your head; kick your teeth; knock your teeth; smash your face; break your jaw; snap your neck; cut you open; slice you; stab you; shoot you
strangle you; hang you; lynch you; rape you; drown you; hurt your family; kill your family; rot in hell; if stupidity paid; if stupidity was; if stupidity were; brain dead moron; spit on your grave; dance on your grave
piss on your grave; ti ammazzo; ti uccido; ti spacco la faccia; spero che tu muoia; spero che muori; devi morire; muori; crepa; vaffanculo; va fan culo; figlio di puttana; figlia di puttana; pezzo di merda; testa di cazzo
sporca puttana; puttana; puttane; troia schifosa; stronzo; stronza; stronzi; coglione; coglioni; bastardo; bastarda; rompicoglioni; succhiami; fai schifo; mi fai schifo; so dove abiti; sappiamo dove abiti; ammazzati; impiccati
feccia; terrone; negraccio; frocio; froci; ricchione
"""

#: hatred of groups
HATE = """
are vermin; are a disease; are a plague; are parasites; are cockroaches; are subhuman; filthy animals; are thieves by blood; thieves by blood; are born thieves; born liars; are criminals by; are dirt; are filth; are scum; are rats
before they multiply; crawled out from; round them up; ruined this country; filth wherever; spit on them; filthy foreigners; send them back; back where they; go back to where; go back to your; even their children; inferior race
master race; white power; ethnic cleansing; gas the; lynch; think with their hormones; put her back behind a stove; back to the kitchen; back in the kitchen; belongs in the kitchen; stay in the kitchen; never let a girl
never let a woman; women cannot; women can not; women are too; like all women; slept her way; sleep her way; llevan el robo en la sangre; el robo en la sangre; son una plaga; habria que exterminarlos; exterminarlos; que exterminar
que los exterminen; son ratas; son basura; son escoria; no son gente; no son personas; son animales; vuelvan a su pais; que vuelva a fregar; vuelva a fregar; vuelva a la cocina; que se puede esperar de una mujer
fuera de nuestro pais; raza inferior; echarlos a todos; echarlos a patadas; sao uma praga; deviam ser exterminados; ser exterminados; exterminados; tem o roubo no sangue; nao sao gente; nao e gente; roubo no sangue; nao sao gente
nao e gente; sao ladroes; ladroes de nascenca; sao ratos; sao lixo; sao animais; volte para a cozinha; volta pra cozinha; volte pra cozinha; lugar de mulher; lavar louca; raca inferior; sont de la vermine; sont une plaie
sont une peste; faut les exterminer; les exterminer; exterminer; le vol dans le sang; sont des rats; sont des parasites; sont des animaux; qu ils rentrent; retourne a la vaisselle; retourne a la cuisine; race inferieure
sont des voleurs; ne sont pas des humains; voleurs de naissance; sind ungeziefer; sind eine plage; sind eine seuche; ausgerottet; ausrotten; sind abschaum; sind ratten; sind parasiten; sind tiere; sind keine menschen
das stehlen im blut; stehlen im blut; diebstahl im blut; diebe von geburt; zuruck an den herd; gehoren ins lager; ins gas; minderwertige rasse; gehoren vertrieben; gehoren abgeschoben; no place among civilised; no place among civilized; they carry filth; filth wherever they; breed like rats; breed like rabbits; breed like animals; breed like vermin; gehoren ins lager; raus mit euch; raus mit denen; raus mit dem pack; rentrez chez vous; voltem para o; voltem para a; vayanse a su pais; geht zuruck wo; auslander raus; are not human; are not people
are not even human; are all thieves; are all criminals; are all liars; are all terrorists; should all die; should all be shot; should all be killed; should all be deported; deserve to die; deserves to die; deserve to be shot
kill them all; hang them all; shoot them all; burn them all; exterminate them; exterminate all; wipe them out; wiped off the face; death to; not welcome here; dirty immigrants; dirty foreigners; filthy immigrants
bloody foreigners; disgusting foreigners; white trash; slut shaming deserves; women are stupid; women are inferior; women belong; a woman s place is; only good for sex; only good for breeding; inferior people; lesser race
parasites on society; leeches on society; vermin like you; scum like you; rats like you; filth like you; people like you should; your kind should; your kind is; your filthy kind; send them all back; go back to your country
go back where you came from; back to their country
"""

#: sexually explicit
SEXUAL = """
leaked porn; free porn; porn of the; hardcore videos; adults only; xxx; girls who ride; lonely wives; want your cock; your cock; my cock; suck my; suck and ride; watch her suck; bent her over; ass needs; dripping wet
take off your bra; take off your clothes; take off your top; take off your panties; sleep with me; sex for money; i get hard every; naked on the desk; naked on the bed; naked in bed; fuck all night; bent over the desk; bends over the desk; bend over the desk; wet and waiting; in those stockings; pulled down her; pulled down his; thrust until; thrust into; until she screamed; until he screamed; moaned; her panties; sit on my face; get on your knees; come to my hotel; nude pictures
nude videos; up your skirt; tasted her; her nipples; your nipples; inner thigh; i want to fuck; fuck you all night; all night long baby; sex tape; send nudes; send me nudes; nude photos; nude pics; naked pictures; naked photos
show your tits; between your legs; between her legs; cum on; make you scream; make you moan; spread your legs; spread her legs; hot horny; escort girls; groped her; lick your; lick her; rape; raped; rapist; te follo
te voy a follar; follarte; quiero follar; te la meto; fotos desnuda; fotos tuyas desnuda; foto desnuda; manda fotos; mandame fotos; mandame una foto; ensename las tetas; muestrame las tetas; chicas calientes; putas calientes
te como a noite; foto pelada; manda foto; manda nudes; mostra os peitos; mostra os seios; quero te comer; vou te comer; gostosa; te baise; je te baise; baise toute la nuit; toi a poil; montre tes seins; montre moi tes; tes seins
deshabille toi; envoie des photos; envoie moi des photos; je veux te; die ganze nacht ficken; dich ficken; schick mir nackt*; nacktbild*; zeig mir deine; zeig deine titten; deine titten; geile sau; du geile; blas mir
waiting for you naked; waiting naked; naked and waiting; horny and; so horny; sex chat; sex cam; live sex; hot singles; barely legal; xxx videos; sexy girls; hot girls; naked girls; nude girls; naked women; naked pics; dick pic
dick pics; my dick; your dick; his dick; big dick; hard cock; big cock; my pussy; your pussy; her pussy; his cock; eat you out; fuck me; fuck you hard; fuck her; fuck him; fucked her; fucked him; want to taste you; taste your
ride you all night; ride you; spank you; spank me; tie you up and; lick you; touch you all over; touch myself; touching myself; get you naked; undress you; want you naked; sex with you; sex with me; make love to you
in bed with you naked; deep inside her; deep inside him; came inside; cum inside; gangbang; orgy; blow job; hand job; sexual favors; sexual favours for
"""

#: harmless phrases around such words
EXCUSES = """
idiot proof; foolproof; naked short; naked shorts; naked call; naked calls; naked put; naked option; naked options; abusive tax; dead cat bounce; stripper well; stripper wells; hell of a run; hell of a quarter; one hell of; crushing the bears; shorts got slaughtered; got slaughtered; shot down the; breast and testicular; breast cancer; testicular cancer; sex discrimination; sexual harassment; sexual orientation; adult incontinence; market penetration; same sex; hostile work environment; sex ratio; pathetic quarter; useless guidance; guidance is useless; guidance was useless; terrible deal; damn we need; useless report; ugly chart; chart looks ugly; looks ugly; ugly quarter; miserable quarter; stupid mistake; stupid question; cocktail; cock and bull; cockpit; rooster; pest control; vermin control; rat race; pig iron; guinea pig; bull and bear; kill switch; killer app; killed the deal; kill the deal; die casting; raise female; hire female; promote female; die cast; poison pill; suicide pill; blood test; blood bank; blood sugar; hardcore gamer*; trash talk; waste of space heaters; lame duck; fat finger; fat tail; fat tails; fatter tail; sick leave; execution risk; toxic asset*; hit list; bastard file; bitch clause; queen bee; male and female; female workforce; female employees; female directors; female share; female representation; prick test; skin prick; pin prick; ass backwards
shot up; shoot the lights; rape seed; rapeseed; a female led; dog that did not bark; bite the bullet; silver bullet; bullet point; bullet points; bullet bond*; bullet loan*; bullet repayment*; bullet maturit*; a bullet in time; knife edge; falling knife; catch a falling knife; dans le sang froid; sans faire de bruit; massacrados; massacrer; verbrannt; gato muerto; nudes palette; strip center; bare naked; naked eye; hormones therapy; growth hormones; stockings and socks; bra and underwear; spanking new; brand spanking; prostate exam; pussy willow; crap game; craps; toda la noche abierto; all night; rope access; wire rope; great tits; blue tits; coal tits; sex education; sex offender registry; sex discrimination; sexual health; sexual assault policy; rape crisis; rape conviction; convicted of rape; rape charges; accused of rape; cum laude; summa cum laude; magna cum laude; xxx rated bonds; adults only ticket; waste of space in; dying embers; death tax; death benefit; death benefits; kill bill; killing it; shoot me an email; shoot me a; shoot you an email; shoot you a; stab at; beat you to it; hang you up; ride you through; hang in there; dyke repair; sea dyke; vermin proof; rat poison; rat trap; parasites in; cockroach control; bitch of a market; basket case
"""
